"""Operator 6: mixing sources to target weights by subset sums over document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import ranked, row_key, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: The budget that the exact search over lengths may be left with, in words, beyond the shortest length; words that it may
#: put back at most, which bounds its memory (a bit for each word and step).
EXACT_WORDS, ROOM = 16_384, 1 << 24


def word_count(text):
    """Number of maximal runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> the same with target: weights repeat over the sources in code point order, null last.

    The targets share `share` times all words by weight; one that is above `most` times its source's words stops
    there and the excess is shared again by weight, until none is above. Each round is one grouped sum over the table
    of sources, which stays distributed.
    """
    spark = sizes.sparkSession
    ordered = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "mix-sources")
    ordered = ordered.withColumns({"__part": F.shiftright("__at", 33), "__i": F.col("__at").bitwiseAND((1 << 33) - 1)})
    start, shifts = 0, []  # a line for each partition of the sorted table of sources
    for part, n in sorted(tuple(r) for r in ordered.groupBy("__part").count().collect()):
        shifts.append((part, start))
        start += n
    shifts = spark.createDataFrame(shifts, "__part long, __start long")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__start") + F.col("__i")) % len(weights) + 1).cast("int"))
    known = written(ordered.join(shifts, "__part").select("source", "source_size", weight.cast("double").alias("weight")), "mix-weights")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = float("inf")
    over = F.lit(most) * F.col("source_size")
    left, free = share * total, known.agg(F.sum("weight")).first()[0] or 1.0
    while True:
        now = left / free if free else level
        capped = F.lit(now) * F.col("weight") > over
        used, free = known.agg(F.sum(F.when(capped, over)), F.sum(F.when(~capped, F.col("weight")))).first()
        left, free = share * total - (used or 0.0), free or 0.0
        if not free or abs(left / free - now) <= 1e-12 * max(1.0, now):
            level = now if not free else left / free
            break
    return known.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), over).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words sum to budget, or come as near below as can be.

    Every length gives its share, rounded down, then long lengths fill up until at most `exact` words (and the shortest
    length) are left. Bounded-knapsack dynamic programming over what is left then finds the nearest sum, bits of one long
    integer standing for the sums that can be reached: documents are put back, up to `room` words, and others taken.
    room grows from nothing until the budget is met, or until more can't help: no set comes nearer if all that was taken
    may be put back, nor beyond `(left + 2 longest + 1) * longest` words, since a longer exchange of documents has a part
    that changes nothing. (At ROOM words the search ends in any case.)
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return np.where(lengths > 0, counts, 0)
    unit = int(np.gcd.reduce(lengths[(lengths > 0) & (counts > 0)]))  # nothing between its multiples can be reached
    lengths, budget, whole, exact = lengths // unit, budget // unit, whole // unit, max(1, exact // unit)
    take = np.array([c * budget // whole if n else 0 for n, c in zip(lengths.tolist(), counts.tolist())], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    order = [i for i in np.argsort(lengths, kind="stable").tolist() if lengths[i] and counts[i]]
    for i in reversed(order):
        n = int(lengths[i])
        if left - exact >= n:
            more = min(int(counts[i] - take[i]), (left - exact) // n)
            take[i] += more
            left -= more * n
    longest = int(lengths[order[-1]])
    most = min(int((take * lengths).sum()), (left + 2 * longest + 1) * longest, max(ROOM // unit, left))
    best, room = None, 0
    while left:
        moves, over = _exchange(lengths, counts, take, order, left, room)
        if best is None or over < best[1]:
            best = moves, over
        if not over or room >= most:
            break
        room = min(most, max(exact, room * 8))
    for i, k in best[0] if best else ():
        take[i] += k
    return take


def _exchange(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, order: list[int], left: int, room: int) -> tuple[list[tuple[int, int]], int]:
    """Moves (length's place, documents taken or, below 0, put back) that leave the fewest of `left` words, and how many these are.

    At most `room` words are put back in all, first of all, so that no sum in between is above the budget.
    """
    goal, reach, steps = room + left, 1 << room, []
    everything, mask = (1 << room + 1) - 1, (1 << room + left + 1) - 1
    for sign in (-1, 1):
        for i in order:
            n = int(lengths[i])
            spare, piece = min(int(take[i] if sign < 0 else counts[i] - take[i]), (room if sign < 0 else room + left) // n), 1
            while spare and not reach >> goal and (sign > 0 or reach != everything):
                k = min(piece, spare)
                now = reach | (reach >> k * n if sign < 0 else (reach << k * n) & mask)
                if now != reach:
                    steps.append((i, sign * k, reach))
                    reach = now
                spare, piece = spare - k, piece * 2
    at, moves = reach.bit_length() - 1, []
    over = goal - at
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            moves.append((i, k))
            at -= k * int(lengths[i])
    return moves, over


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, and times, the number of copies to take.

    A document goes into the mix whole: as often as its source's target exceeds its words, and once more where the
    subset sum picks it. Which documents of a length are picked is settled by a hash of seed and doc_id, so reruns
    agree. Null texts and texts without words have size 0 and take no words; a null source is a source of its own,
    last in order. Rows of the same doc_id are ranked on their own. An empty table gives an empty result; other columns
    of docs are not looked at.

    Each source's length counts (not its documents) are brought together in one task; the driver sees a sum for each
    round of targets.
    """
    slim = written(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")), "mix-rows")
    # a null source takes part under a key that no source has
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    slim = slim.withColumn("key", key)
    counts = written(slim.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    aims = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    aims = aims.withColumn("key", key).drop("source")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        have, aim = int(pdf["source_size"].iloc[0]), int(round(float(pdf["target"].iloc[0])))
        base = aim // have if have else 0
        took = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), aim - base * have if have else 0)
        return pdf.assign(base=base, picks=took)[["key", "size", "n", "source_size", "target", "base", "picks"]]

    plan = written(
        counts.drop("source").join(aims, "key").groupBy("key").applyInPandas(pick, "key string, size long, n long, source_size long, target double, base long, picks long"),
        "mix-plan",
    )
    rows = ranked(slim.join(plan, ["key", "size"]), ["key", "size"], [F.xxhash64(F.lit(seed), F.col("doc_id")), row_key()], "n")
    times = F.col("base") + F.when(F.col("rank") < F.col("picks"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def op6_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the mix of all sources takes, and how often, in words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
