"""Repairs: sweeps of what is stale, walks that compare state with the sources, rebuilds and probe passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.errors import InvalidArgument
from docweave.operators import state as st
from docweave.operators.engine import Engine

#: Rows of a sweep, seconds that a mark must be old, ids of a reverse sweep's page.
SWEEP_BATCH, SWEEP_THRESHOLD = 500, 300.0
REVERSE_PAGE = 200


def sweep(engine: Engine, threshold: float = SWEEP_THRESHOLD, batch: int = SWEEP_BATCH) -> int:
    """Builds the marks whose turn it is, tombstones first; a failed build waits longer each time. Returns how many."""
    now = engine.clock()
    due = st.stale_order(engine.state(), now, threshold, batch)
    path = f"{engine.root}/sweeps/{engine.take() + 1:020d}"
    st.claim(due, now).write.mode("overwrite").parquet(path)
    claimed = engine.spark.read.parquet(path)
    n = claimed.count()
    if not n:
        return 0
    engine.states.append(claimed)
    for part in (claimed.where("tombstone"), claimed.where("not tombstone")):
        if part.isEmpty():
            continue
        try:
            engine.build(part.select("type", "id"))
        except Exception:
            tokens = part.select("type", "id", F.col("owner_seq").alias("token"))
            engine.states.append(st.release(engine.state(), tokens, engine.clock(), failed=True))
            raise
    return n


def missing(live: DataFrame, listed: DataFrame) -> DataFrame:
    """The live ids that the source doesn't return any more: an anti-join, each once."""
    return live.select("type", "id").distinct().join(listed.select("id").distinct(), "id", "left_anti")


@dataclass
class ReverseCounts:
    listed: int = 0
    suspects: int = 0


def reverse_sweep(engine: Engine, resource: str, after: str | None = None, page: int | None = None) -> tuple[ReverseCounts, str | None]:
    """Marks live rows that the source no longer returns; all at once, or one keyset page from `after` on.

    Returns the counts and, for a page that was full, the id to go on after. Rows are probed for each metadata map
    together, which a source that depends on metadata needs; here the source is one table for all of them.
    """
    state = engine.state()
    live = state.where((F.col("type") == resource) & ~F.col("tombstone")) if page is None else st.live_rows(state, resource, after, page)
    suspects = missing(live, engine.sources.listing(resource))
    listed, last = live.agg(F.count(F.lit(1)), F.max("id")).first()
    n = suspects.count()
    if n:
        engine.mark(suspects)
    return ReverseCounts(listed, n), (last if page is not None and listed == page else None)


def by_metadata(state: DataFrame) -> DataFrame:
    """metadata_key, ids: rows with equal metadata, whatever its order; null and empty are one."""
    return state.groupBy("type", st.canonical_metadata(F.col("metadata")).alias("metadata_key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def rebuild(engine: Engine, resource: str, ids: DataFrame | None = None, versions: list[int] | None = None) -> DataFrame:
    """Builds the given ids, or the source's whole listing and all live rows, of a type.

    With versions named only those are built. A row that none of them has a document for stays, marked for the sweep, whose
    build asks them all.
    """
    listed = ids.select("id") if ids is not None else engine.sources.listing(resource).select("id").unionByName(
        engine.state().where((F.col("type") == resource) & ~F.col("tombstone")).select("id")
    )
    asked = listed.distinct().select(F.lit(resource).alias("type"), "id")
    known = {v.number for v in engine.config.resource(resource).versions}
    if versions and not set(versions) <= known:
        raise InvalidArgument(f"{resource!r} has no versions {sorted(set(versions) - known)}")
    return engine.build(asked, {resource: versions} if versions else None)


def forward_walk(engine: Engine, resource: str, after: str | None = None, page: int = 1000) -> Iterator[str]:
    """Rebuilds a whole type page by page, in order of id; yields the cursor after each page, from which it can resume."""
    while True:
        ids = engine.sources.after(resource, after, page).select("id")
        n, last = ids.agg(F.count(F.lit(1)), F.max("id")).first()
        if not n:
            return
        rebuild(engine, resource, ids)
        yield last
        if n < page:
            return
        after = last


@dataclass
class ProbeCounts:
    asked: int = 0
    excluded: int = 0
    marked: int = 0


def probe_pass(engine: Engine, resource: str, version: int) -> ProbeCounts:
    """Settles live rows that have no edge set of a version and aren't marked.

    Those that the source doesn't return lose that version's document and get an empty edge set, unmarked; the others
    are marked for a build.
    """
    rows = st.uncovered(engine.state(), engine.edge_sets(), resource, version)
    gone = missing(rows, engine.sources.listing(resource))
    path = f"{engine.root}/probes/{engine.take() + 1:020d}"
    rows.select("type", "id").join(gone.withColumn("gone", F.lit(True)), ["type", "id"], "left").select("type", "id", F.coalesce("gone", F.lit(False)).alias("gone")).write.mode("overwrite").parquet(path)
    found = engine.spark.read.parquet(path)
    excluded, back = found.where("gone"), found.where("not gone")
    counts = ProbeCounts(found.count(), excluded.count(), back.count())
    if counts.excluded:
        seq = engine.take() + 1
        engine.store.delete(resource, version, excluded.select("id"), seq)
        empty = F.array().cast("array<struct<type: string, id: string>>")
        engine.edge_log.append(excluded.select("type", "id", F.lit(version).alias("schema_version"), F.lit(seq).cast("long").alias("build_seq"), empty.alias("children")))
    if counts.marked:
        engine.mark(back.select("type", "id"))
    return counts


def reconcile(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """id, outcome: doc, nil or err. asked: id; answers: id, outcome (doc or nil). Unanswered ids are errors, never nil.

    A duplicate answer, or one that nobody asked for, fails the whole call.
    """
    twice = answers.groupBy("id").count().where("count > 1")
    unasked = answers.join(asked, "id", "left_anti")
    bad = twice.select("id").unionByName(unasked.select("id")).limit(1).collect()
    if bad:
        raise InvalidArgument(f"the answer for {bad[0][0]!r} is a duplicate or wasn't asked for")
    return asked.select("id").distinct().join(answers, "id", "left").select("id", F.coalesce("outcome", F.lit("err")).alias("outcome"))


def walk_outcomes(answers: DataFrame, versions: list[int], may_delete: bool) -> DataFrame:
    """id, outcome of a walk over the listings of several versions: answers are (id, version, outcome doc or nil).

    `contradicts`: one version listed the row both with and without data. `partial`: the first version's listing omitted
    it, and an omission is no nil. `incomplete`: another one did. Otherwise `built` with a document of any version, and
    without one `deleted`, or `left` (marked for the sweep) if the walk asked only some of the versions.
    """
    doc, nil = (F.collect_set(F.when(F.col("outcome") == o, F.col("version"))) for o in ("doc", "nil"))
    seen = answers.groupBy("id").agg(doc.alias("doc"), nil.alias("nil"))
    every = F.array_union("doc", "nil")
    outcome = (
        F.when(F.arrays_overlap("doc", "nil"), "contradicts").when(~F.array_contains(every, versions[0]), "partial").when(F.size(every) < len(versions), "incomplete")
        .when(F.size("doc") > 0, "built").otherwise("deleted" if may_delete else "left")
    )
    return seen.select("id", outcome.alias("outcome"))


def first_reports(answers: DataFrame) -> DataFrame:
    """id, metadata: of what the versions' plans report (id, version, metadata), the first that isn't empty, in order of version."""
    told = F.coalesce(F.size("metadata") > 0, F.lit(False))
    return answers.groupBy("id").agg(F.min_by(F.when(told, F.col("metadata")), F.when(told, F.col("version"))).alias("metadata"))


def merge_versions(answers: DataFrame) -> DataFrame:
    """id, docs, nils, first_error over the versions' answers (id, version, outcome, error), in order of version."""
    failed = F.when(F.col("outcome") == "err", F.coalesce("error", F.lit("unanswered")))
    return answers.groupBy("id").agg(
        F.count_if(F.col("outcome") == "doc").alias("docs"), F.count_if(F.col("outcome") == "nil").alias("nils"),
        F.min_by(failed, F.when(failed.isNotNull(), F.col("version"))).alias("first_error"),
    )
