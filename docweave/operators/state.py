"""Change propagation as folds over state tables: version gate, marks, fan-out, drift, sweeps' order, coverage.

State rows are keyed (type, id): version, build_idx, stale_seq, change_seq, stale_since, tombstone, metadata, owner_seq,
owner_since, sweep_attempts, sweep_after. Times are seconds since 1970, sequences come from one counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.config import Config
from docweave.errors import InvalidArgument, RegistrationAborted, UnknownResource

STATE = (
    "type string, id string, version long, build_idx long, stale_seq long, change_seq long, stale_since double, tombstone boolean, "
    "metadata map<string,string>, owner_seq long, owner_since double, sweep_attempts int, sweep_after double"
)
EDGES = "type string, id string, schema_version int, build_seq long, children array<struct<type: string, id: string>>"
NOTIFICATION = "kind string, type string, id string, metadata map<string,string>, version long, ord long"

#: Fixed values, in seconds: an owner's lease, and the first and longest wait after a failed build.
LEASE = 30.0
BACKOFF_BASE, BACKOFF_MAX = 300.0, 86_400.0


def canonical_metadata(m: Column) -> Column:
    """Equal for equal maps whatever their order; null and empty are the same."""
    entries = F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    return F.to_json(F.array_sort(entries))


def arrival() -> list[Column]:
    """The order in which a resource's notifications are judged: by ord, those of one ord by version, then by kind."""
    return [F.col("ord"), F.coalesce("version", F.lit(0)), F.col("kind")]


def gate(log: DataFrame) -> DataFrame:
    """A whole notification log, in order of arrival: accepted and the version stored after each row, per (type, id).

    A delete is accepted and stores 0; version 0 is accepted and stores nothing; any other version is accepted if it is
    above the stored one. Between deletes that is a running maximum, so the fold needs one sort by resource and no loop.
    """
    own = Window.partitionBy("type", "id").orderBy(*arrival())
    is_delete = F.col("kind") == "deleted"
    lives = log.withColumn("__life", F.coalesce(F.sum(F.when(is_delete, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    life = Window.partitionBy("type", "id", "__life").orderBy(*arrival())
    version = F.when(is_delete, F.lit(0)).otherwise(F.coalesce(F.col("version"), F.lit(0)))
    before = F.coalesce(F.max(version).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    accepted = is_delete | (version == 0) | (version > before)
    stored = F.when(is_delete, F.lit(0)).otherwise(F.greatest(before, version))
    return lives.withColumn("accepted", accepted).withColumn("stored", stored).drop("__life")


def check_batch(batch: DataFrame, config: Config) -> None:
    """A batch is refused whole if a type is unknown, a resource comes twice or a kind is none; an empty one is fine."""
    known = list(config.by_type)
    odd = batch.where(~F.coalesce(F.col("type").isin(known), F.lit(False)) if known else F.lit(True)).select("type").limit(1).collect()
    if odd:
        raise UnknownResource(f"unknown resource type {odd[0][0]!r}: nothing was registered")
    if not batch.where(F.col("id").isNull() | (F.col("id") == "")).isEmpty():
        raise InvalidArgument("a notification has no id: nothing was registered")
    twice = batch.groupBy("type", "id").count().where("count > 1").limit(1).collect()
    if twice:
        raise RegistrationAborted(f"{twice[0]['type']} {twice[0]['id']} comes twice in a batch: nothing was registered")


def fan_out(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """type, id of every document that holds a changed row, in any version, once each; changed ones themselves left out."""
    links = edges.select("type", "id", F.explode("children").alias("c")).select("type", "id", F.col("c.type").alias("ctype"), F.col("c.id").alias("cid"))
    hit = changed.select(F.col("type").alias("ctype"), F.col("id").alias("cid")).distinct()
    parents = links.join(hit, ["ctype", "cid"]).select("type", "id").distinct()
    return parents.join(changed.select("type", "id").distinct(), ["type", "id"], "left_anti")


def missed_parents(accepted: DataFrame, marked: DataFrame, edges: DataFrame) -> DataFrame:
    """type, id of documents that hold an accepted item by the edges as they are after its commit, and aren't marked yet.

    A build that stored its edges while the batch was written is in neither the batch's fan-out nor its own drift check.
    """
    return fan_out(accepted, edges).join(marked.select("type", "id").distinct(), ["type", "id"], "left_anti")


def register(batch: DataFrame, state: DataFrame, edges: DataFrame, base: int, last: int, now: float) -> DataFrame:
    """The state rows that a batch of notifications (each resource once) writes, with role and accepted.

    batch's ord counts from 0; its values of the sequence are base + 1 + ord, and parents take the value `last` above
    them. An accepted item takes a fresh sequence value as change and stale mark, keeps the oldest stale time, and replaces
    its metadata; a stale one writes nothing but uses up its value. Parents of accepted items are marked, each once,
    unless they are accepted items themselves; their metadata and versions stay. Rows of role `stale` aren't to be kept.
    """
    asked = batch.withColumn("seq", F.lit(base) + F.col("ord") + 1)
    old = state.select("type", "id", *[F.col(c).alias(f"o_{c}") for c in state.columns if c not in ("type", "id")])
    met = asked.join(old, ["type", "id"], "left")
    is_delete, version = F.col("kind") == "deleted", F.coalesce(F.col("version"), F.lit(0))
    accepted = is_delete | (version == 0) | (F.coalesce("o_version", F.lit(0)) < version)
    stored = F.when(is_delete, F.lit(0)).when(version == 0, F.coalesce("o_version", F.lit(0))).otherwise(version)
    judged = met.withColumn("accepted", accepted)
    items = judged.select(
        "type", "id", stored.cast("long").alias("version"), F.coalesce("o_build_idx", F.lit(0)).alias("build_idx"), F.col("seq").alias("stale_seq"), F.col("seq").alias("change_seq"),
        F.coalesce("o_stale_since", F.lit(now)).alias("stale_since"), is_delete.alias("tombstone"), F.col("metadata"), F.col("o_owner_seq").alias("owner_seq"),
        F.col("o_owner_since").alias("owner_since"), F.coalesce("o_sweep_attempts", F.lit(0)).alias("sweep_attempts"), F.col("o_sweep_after").alias("sweep_after"),
        F.when(F.col("accepted"), "item").otherwise("stale").alias("role"), "accepted",
    )
    changed = judged.where("accepted").select("type", "id")
    return items.unionByName(mark(fan_out(changed, edges), state, last, now).withColumn("role", F.lit("parent")).withColumn("accepted", F.lit(True)))


def mark(ids: DataFrame, state: DataFrame, seq: int, now: float) -> DataFrame:
    """State rows of (type, id) with a fresh stale mark; the oldest stale time and all else is kept, missing rows are made."""
    old = state.select("type", "id", *[F.col(c).alias(f"o_{c}") for c in state.columns if c not in ("type", "id")])
    met = ids.select("type", "id").distinct().join(old, ["type", "id"], "left")
    keep = [c for c in state.columns if c not in ("type", "id", "stale_seq", "stale_since")]
    default = {"version": 0, "build_idx": 0, "change_seq": 0, "sweep_attempts": 0, "tombstone": False}
    kept = [(F.coalesce(F.col(f"o_{c}"), F.lit(default[c])) if c in default else F.col(f"o_{c}")).cast(state.schema[c].dataType).alias(c) for c in keep]
    return met.select("type", "id", F.lit(seq).cast("long").alias("stale_seq"), F.coalesce("o_stale_since", F.lit(now)).alias("stale_since"), *kept).select(*state.columns)


def claimable(now: float, lease: float = LEASE) -> Column:
    """No one owns the row's build, or its owner's lease is over."""
    return F.col("owner_since").isNull() | (F.col("owner_since") < now - lease)


def claim(state: DataFrame, now: float, lease: float = LEASE) -> DataFrame:
    """Stale rows that can be claimed, with the owner's token (the stale mark it saw) and time."""
    rows = state.where(F.col("stale_seq").isNotNull() & claimable(now, lease))
    return rows.withColumn("owner_seq", F.col("stale_seq")).withColumn("owner_since", F.lit(now))


def renew(state: DataFrame, tokens: DataFrame, now: float) -> DataFrame:
    """Rows whose token (type, id, token) still owns them, with the time renewed."""
    met = state.join(tokens.select("type", "id", "token"), ["type", "id"])
    return met.where(F.col("owner_seq") == F.col("token")).drop("token").withColumn("owner_since", F.lit(now))


def release(state: DataFrame, tokens: DataFrame, now: float, failed: bool = False) -> DataFrame:
    """Rows given back by their owner; a failed build waits longer each time, unless its row changed since the claim."""
    met = state.join(tokens.select("type", "id", "token"), ["type", "id"]).where(F.col("owner_seq") == F.col("token"))
    rows = met.withColumn("owner_seq", F.lit(None).cast("long")).withColumn("owner_since", F.lit(None).cast("double"))
    if failed:
        same = ~F.coalesce(F.col("change_seq") > F.col("token"), F.lit(False))
        attempts = F.when(same, F.col("sweep_attempts") + 1).otherwise(F.col("sweep_attempts")).cast("int")
        rows = rows.withColumn("sweep_after", F.when(same, F.lit(now) + backoff(F.col("sweep_attempts") + 1)).otherwise(F.col("sweep_after"))).withColumn("sweep_attempts", attempts)
    return rows.drop("token")


def backoff(attempts: Column, base: float = BACKOFF_BASE, most: float = BACKOFF_MAX) -> Column:
    """base * 2^(attempts - 1), no more than most; attempts below 1 count as 1."""
    power = F.least(F.greatest(attempts, F.lit(1)) - 1, F.lit(62))
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), power), F.lit(float(most)))


def finish(state: DataFrame, built: DataFrame) -> DataFrame:
    """Rows of built (type, id, seen, build_idx): settled if the mark is the one seen, else left stale for one more build."""
    met = state.join(built.select("type", "id", "seen", F.col("build_idx").alias("__b")), ["type", "id"])
    settled = F.col("stale_seq") <= F.col("seen")
    gone = lambda c, kind: F.when(settled, F.lit(None).cast(kind)).otherwise(F.col(c))
    rows = met.withColumns({
        "stale_since": gone("stale_since", "double"), "sweep_attempts": F.lit(0), "sweep_after": F.lit(None).cast("double"),
        "owner_seq": F.lit(None).cast("long"), "owner_since": F.lit(None).cast("double"), "build_idx": F.greatest("build_idx", "__b"), "stale_seq": gone("stale_seq", "long"),
    })
    return rows.drop("seen", "__b").select(*state.columns)


def begin_delete(state: DataFrame, asked: DataFrame, base: int, now: float) -> DataFrame:
    """The rows of asked (type, id, token, nth) that are still tombstones, with a fresh build_idx, base + 1 + nth; superseded or not.

    A token that still owns its row renews the lease. A row that was made again meanwhile, or is gone, is superseded and
    stays as it is (a row that is gone comes back with its keys only).
    """
    met = asked.join(state, ["type", "id"], "left")
    alive = F.coalesce("tombstone", F.lit(False))
    renewed = F.when(alive & (F.col("token") != 0) & (F.col("owner_seq") == F.col("token")), F.lit(now)).otherwise(F.col("owner_since"))
    rows = met.withColumn("superseded", ~alive).withColumn("build_idx", F.when(alive, F.lit(base) + 1 + F.col("nth")).otherwise(F.col("build_idx"))).withColumn("owner_since", renewed)
    return rows.select(*state.columns, "superseded")


def guarded_delete(state: DataFrame, asked: DataFrame, now: float) -> DataFrame:
    """What becomes of rows whose documents were deleted, asked being type, id, seen, token: the rows, removed or not.

    A row still marked as it was seen goes. One that was marked again stays for a follow-up: its owner's token is taken
    anew from the mark, so the same owner builds it next, and its waiting time starts over.
    """
    met = state.join(asked.select("type", "id", "seen", "token"), ["type", "id"])
    removed = F.coalesce(F.col("stale_seq") == F.col("seen"), F.lit(False))
    again = ~removed & F.col("stale_seq").isNotNull()
    mine = again & (F.col("token") != 0) & F.coalesce(F.col("owner_seq") == F.col("token"), F.lit(False))
    rows = met.withColumns({
        "removed": removed, "follow_up": mine, "owner_seq": F.when(mine, F.col("stale_seq")).otherwise(F.col("owner_seq")), "owner_since": F.when(mine, F.lit(now)).otherwise(F.col("owner_since")),
        "sweep_attempts": F.when(again, F.lit(0)).otherwise(F.col("sweep_attempts")), "sweep_after": F.when(again, F.lit(None).cast("double")).otherwise(F.col("sweep_after")),
    })
    return rows.select(*state.columns, "removed", "follow_up")


def drifted(built: DataFrame, state: DataFrame, start: int) -> DataFrame:
    """type, id of built documents (type, id, children) of which a child changed after sequence start."""
    links = built.select("type", "id", F.explode("children").alias("c")).select("type", "id", F.col("c.type").alias("ctype"), F.col("c.id").alias("cid"))
    changed = state.where(F.col("change_seq") > start).select(F.col("type").alias("ctype"), F.col("id").alias("cid"))
    return links.join(changed, ["ctype", "cid"], "left_semi").select("type", "id").distinct()


def stale_order(state: DataFrame, now: float, threshold: float, limit: int) -> DataFrame:
    """The rows a sweep takes next: marked longer ago than threshold, unowned, past their wait; oldest turn first."""
    due = state.where(F.col("stale_since").isNotNull() & (F.col("stale_since") <= now - threshold) & claimable(now) & (F.col("sweep_after").isNull() | (F.col("sweep_after") <= now)))
    return due.orderBy(F.coalesce("sweep_after", "stale_since"), "type", "id").limit(limit)


def backlog(state: DataFrame) -> DataFrame:
    """type, stale, oldest: how many rows wait for a build, and since when."""
    return state.where(F.col("stale_since").isNotNull()).groupBy("type").agg(F.count(F.lit(1)).alias("stale"), F.min("stale_since").alias("oldest"))


def uncovered(state: DataFrame, edge_sets: DataFrame, resource: str, version: int) -> DataFrame:
    """Live rows of a type that no build is due for and that have no edge set of the version."""
    rows = state.where((F.col("type") == resource) & ~F.col("tombstone") & F.col("stale_since").isNull())
    return rows.join(edge_sets.where(F.col("schema_version") == version).select("type", "id"), ["type", "id"], "left_anti")


def coverage(state: DataFrame, edge_sets: DataFrame, resource: str, version: int) -> DataFrame:
    """One row: live, uncovered."""
    live = state.where((F.col("type") == resource) & ~F.col("tombstone"))
    sets = edge_sets.where((F.col("type") == resource) & (F.col("schema_version") == version)).select("type", "id", F.lit(True).alias("has"))
    met = live.join(sets, ["type", "id"], "left")
    return met.agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col("has").isNull() & F.col("stale_since").isNull()).alias("uncovered"))


def live_rows(state: DataFrame, resource: str, after: str | None, limit: int) -> DataFrame:
    """A page of a type's live rows in order of id."""
    rows = state.where((F.col("type") == resource) & ~F.col("tombstone"))
    if after is not None:
        rows = rows.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def neighbours(edges: DataFrame, resource: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of one resource over all versions, once each."""
    links = edges.select("type", "id", F.explode("children").alias("c"))
    parents = links.where((F.col("c.type") == resource) & (F.col("c.id") == id_)).select("type", "id").distinct()
    children = links.where((F.col("type") == resource) & (F.col("id") == id_)).select("c.type", "c.id").distinct()
    return parents, children


def last_sequence(state: DataFrame, edge_sets: DataFrame) -> DataFrame:
    """One row, seq: the highest value that any stamp holds, from which a lost counter is restored."""
    stamps = state.agg(F.max(F.greatest("build_idx", "stale_seq", "change_seq")).alias("seq")).unionByName(edge_sets.agg(F.max("build_seq").alias("seq")))
    return stamps.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))


def unlinked(links: DataFrame, edge_sets: DataFrame) -> DataFrame:
    """type, id of parents that a row names (type, id, ctype, cid) without being held by them yet.

    That is how a parent hears of its first child; later on the edge is there, and a change of the row marks it.
    """
    held = edge_sets.select("type", "id", F.explode("children").alias("c")).select("type", "id", F.col("c.type").alias("ctype"), F.col("c.id").alias("cid"))
    return links.join(held, ["type", "id", "ctype", "cid"], "left_anti").select("type", "id").distinct()
