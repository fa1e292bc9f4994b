"""The engine: registers changes, builds documents and edges, repairs, migrates, and answers searches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import Config
from docweave.errors import StaleVersion
from docweave.operators import state as st
from docweave.operators.search import Middleware, Searcher
from docweave.plans import denorm
from docweave.plans.schema import document_schema
from docweave.sources import files
from docweave.sources.registry import Sources
from docweave.sources.store import DocumentStore, Log, index_name


@dataclass
class Engine:
    """One writer over a root folder: documents, state, edge sets and a sequence counter.

    Every step appends to a log before the next begins, and every fold is latest-wins by sequence, so a step that is run
    again after a failure changes nothing. keep says, for a (type, version), which built documents exist at all: those
    for which it is false are as if the source had none for that version.
    """

    spark: SparkSession
    config: Config
    sources: Sources
    root: str
    keep: dict[tuple[str, int], Callable[[DataFrame], Column]] = field(default_factory=dict)
    blocks: dict[str, dict[str, denorm.BlockPlan]] = field(default_factory=dict)
    middlewares: tuple[Middleware, ...] = ()
    clock: Callable[[], float] = time.time

    def __post_init__(self):
        self.store = DocumentStore(self.spark, self.root)
        self.states = Log(self.spark, f"{self.root}/state", ("type", "id"))
        self.edge_log = Log(self.spark, f"{self.root}/edges", ("type", "id", "schema_version"), ("build_seq",))

    # state

    def state(self) -> DataFrame:
        found = self.states.latest()
        return self.spark.createDataFrame([], st.STATE) if found is None else found

    def edge_sets(self) -> DataFrame:
        found = self.edge_log.latest()
        return self.spark.createDataFrame([], st.EDGES) if found is None else found

    def take(self, n: int = 1) -> int:
        """Reserves n values of the sequence; returns the one before the first."""
        path = f"{self.root}/sequence.json"
        at = files.read_json(self.spark, path, None)
        if at is None:
            at = st.last_sequence(self.state(), self.edge_sets()).first()[0] if self.states.manifest()["schema"] else 0
        files.write_json(self.spark, path, at + n)
        return at

    def set_config(self, config: Config, sources: Sources | None = None) -> None:
        """Swaps plans and configuration; every type must have a source. What was checked when it was made holds from the next step on."""
        for r in config.resources:
            (sources or self.sources).check(r.type)
        self.config, self.sources = config, sources or self.sources

    # registration

    def register(self, batch: DataFrame) -> DataFrame:
        """Takes in a batch of notifications (kind, type, id, metadata, version) whole or not at all.

        Returns type, id, accepted for each; a stale one has written nothing and marked no parent.
        """
        if "ord" not in batch.columns:
            batch = batch.withColumn("ord", F.monotonically_increasing_id())
        batch = batch.cache()
        try:
            st.check_batch(batch, self.config)
            n = batch.count()
            if not n:
                return self.spark.createDataFrame([], "type string, id string, accepted boolean")
            top = (batch.agg(F.max("ord")).first()[0] or 0) + 2
            base = self.take(top)
            rows = st.register(batch, self.state(), self.edge_sets(), base, base + top, self.clock())
            segment = f"{self.root}/registered/{base:020d}"
            rows.write.mode("overwrite").parquet(segment)
            rows = self.spark.read.parquet(segment)
            self.states.append(rows.where("role <> 'stale'").drop("role", "accepted"))
            # edges that another writer committed while the batch was written
            missed = st.missed_parents(rows.where("role = 'item'"), rows.where("role <> 'stale'"), self.edge_sets())
            if not missed.isEmpty():
                self.mark(missed)
            return rows.where("role <> 'parent'").select("type", "id", "accepted")
        finally:
            batch.unpersist()

    def notify(self, kind: str, type_: str, id_: str, version: int = 0, metadata: dict | None = None) -> None:
        """A batch of one; a version that isn't above the stored one raises StaleVersion."""
        rows = self.spark.createDataFrame([(kind, type_, id_, metadata or {}, version, 0)], st.NOTIFICATION)
        if not self.register(rows).first()["accepted"]:
            raise StaleVersion(f"{type_} {id_} is at a version of at least {version}")

    def mark(self, ids: DataFrame) -> None:
        self.states.append(st.mark(ids, self.state(), self.take() + 1, self.clock()))

    # building

    def build(self, ids: DataFrame | None = None, versions: dict[str, list[int]] | None = None, settle: bool = True) -> DataFrame:
        """Builds every stale row (or those of ids: type, id) once, all types and versions of a batch together.

        Order: begin; documents of each version; tombstones for what the source no longer has; edge sets; parents that
        built rows name themselves; drift; finish. A row whose versions all have no document goes from the state too,
        unless it was marked again meanwhile. Where only some versions were built and none of them has a document, the
        others were not asked: the row stays, marked for the sweep. Returns type, id, outcome.
        """
        start = self.take()
        seq = start + 1
        state = self.state()
        due = state.where(F.col("stale_seq").isNotNull())
        if ids is not None:
            asked = ids.select("type", "id").distinct()
            due = state.join(asked, ["type", "id"])
            missing = asked.join(state, ["type", "id"], "left_anti")
            if not missing.isEmpty():
                self.states.append(st.mark(missing, state, seq, self.clock()))
                state = self.state()
                due = state.join(asked, ["type", "id"])
        path = f"{self.root}/builds/{seq:020d}"
        due.select("type", "id", F.coalesce("stale_seq", F.lit(0)).alias("seen"), "tombstone").write.mode("overwrite").parquet(f"{path}/due")
        due = self.spark.read.parquet(f"{path}/due")
        types = [r[0] for r in due.select("type").distinct().collect()]  # no more than are configured
        for name in sorted(t for t in types if t in self.config.by_type):
            self._build_type(name, due.where(F.col("type") == name), seq, path, (versions or {}).get(name))
        answers = [f"{path}/answers/{t}" for t in types if t in self.config.by_type]
        if not answers:
            return self.spark.createDataFrame([], "type string, id string, outcome string")
        found = self.spark.read.parquet(*answers)
        if settle:
            partial = [t for t, some in (versions or {}).items() if {v.number for v in self.config.resource(t).versions} - set(some)]
            self._settle(found, seq, partial)
        return found.select("type", "id", F.when(F.col("kept") > 0, "built").otherwise("gone").alias("outcome"))

    def _build_type(self, name: str, due: DataFrame, seq: int, path: str, only: list[int] | None) -> None:
        resource = self.config.resource(name)
        wanted = [v for v in resource.ascending if only is None or v.number in only]
        live = due.where(~F.col("tombstone"))
        answers = None
        for v in wanted:
            if self.store.mapping(name, v.number) is None:
                self.store.put_mapping(name, v.number, document_schema(v))
            docs = denorm.documents(self.config, self.sources, name, v.number, live.select("id"), self.blocks.get(name))
            exists = F.col("found")
            if (name, v.number) in self.keep:
                exists = exists & F.coalesce(self.keep[(name, v.number)](docs), F.lit(False))
            docs = docs.withColumn("__exists", exists)
            docs.write.mode("overwrite").parquet(f"{path}/docs/{name}-{v.number}")
            docs = self.spark.read.parquet(f"{path}/docs/{name}-{v.number}")
            kept = docs.where("__exists").drop("found", "__exists")
            self.store.upsert(name, v.number, kept, seq)
            nil = due.select("id").join(kept.select("id"), "id", "left_anti")
            self.store.delete(name, v.number, nil, seq)
            linked = denorm.edges(self.config, kept, name, v.number)
            sets = due.select("id").join(linked, "id", "left").select(
                F.lit(name).alias("type"), "id", F.lit(v.number).alias("schema_version"), F.lit(seq).cast("long").alias("build_seq"),
                F.coalesce("children", F.array().cast("array<struct<type: string, id: string>>")).alias("children"),
            )
            self.edge_log.append(sets)
            part = due.select("type", "id", "seen").join(kept.select("id", F.lit(1).alias("has")), "id", "left").select("type", "id", "seen", F.coalesce("has", F.lit(0)).alias("has"))
            answers = part if answers is None else answers.unionByName(part)
        # a version that is configured no more holds nothing any longer
        old = self.edge_sets().where((F.col("type") == name) & ~F.col("schema_version").isin([v.number for v in resource.versions])).join(due.select("id"), "id", "left_semi")
        if not old.isEmpty():
            self.edge_log.append(old.select("type", "id", "schema_version", F.lit(seq).cast("long").alias("build_seq"), "children").withColumn("deleted", F.lit(True)))
        answers.groupBy("type", "id", "seen").agg(F.sum("has").alias("kept")).write.mode("overwrite").parquet(f"{path}/answers/{name}")
        state = self.state()
        links = denorm.parent_links(self.config, self.sources, name, live.select("id"))
        linked = st.unlinked(links, self.edge_sets())
        built = self.edge_sets().where((F.col("type") == name) & (F.col("build_seq") == seq))
        again = linked.unionByName(st.drifted(built, state, seq)).distinct()
        if not again.isEmpty():
            self.states.append(st.mark(again, state, self.take() + 1, self.clock()))

    def _settle(self, found: DataFrame, seq: int, partial: list[str]) -> None:
        state = self.state()
        built = found.where(F.col("kept") > 0).select("type", "id", "seen", F.lit(seq).cast("long").alias("build_idx"))
        self.states.append(st.finish(state, built))
        whole = ~F.col("type").isin(partial) if partial else F.lit(True)
        gone = found.where((F.col("kept") == 0) & whole).select("type", "id", "seen")
        rows = state.join(gone, ["type", "id"]).where(F.coalesce("stale_seq", F.lit(0)) <= F.col("seen")).drop("seen")
        self.states.append(rows.withColumn("deleted", F.lit(True)))
        if partial:
            left = found.where((F.col("kept") == 0) & ~whole).select("type", "id")
            if not left.isEmpty():
                self.mark(left)

    def run_until_settled(self, rounds: int = 20) -> int:
        """Builds until nothing is stale; returns the number of rounds."""
        for i in range(rounds):
            if self.state().where(F.col("stale_seq").isNotNull()).isEmpty():
                return i
            self.build()
        return rounds

    # searching

    def empty(self, resource: str) -> DataFrame:
        schema = document_schema(self.config.resource(resource).version())
        return self.spark.createDataFrame([], schema).withColumn("id", F.col("resource_id"))

    def searcher(self) -> Searcher:
        return Searcher(self.config, self.store.read, self.empty, self.middlewares)

    def point_aliases(self) -> None:
        for r in self.config.resources:
            self.store.point(r.type, index_name(r.type, r.read_version))
