"""Operator 5: shards of nearly equal bytes by longest-processing-time scheduling of groups of equal texts."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import ranked, row_key, table, written

SHARDS = 8
#: Group sizes keep this many leading bits; so there are at most 2**15 classes for each doubling of size beyond 2**16.
CLASS_BITS = 16



def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """Longest processing time first: for each size class the number of its groups that each shard takes.

    classes: (class, number of groups, their total size). Groups go in falling order of size to the least-loaded shard,
    ties to the smaller shard number. A class's groups count as equally long, so all but the last few of a class are
    dealt at once, up to a common level; the rest go one by one through the heap.
    """
    loads = [0.0] * shards
    plan = {}
    for size_class, n, total in sorted(classes, reverse=True):
        each = total / n
        given = _fill(loads, n, each)
        for i, c in enumerate(given):
            loads[i] += c * each
        heap = [(load, i) for i, load in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            load, i = heap[0]
            given[i] += 1
            loads[i] = load + each
            heapq.heapreplace(heap, (loads[i], i))
        plan[size_class] = given
    return plan


def _fill(loads: list[float], n: int, each: float) -> list[int]:
    """How many of n pieces of length each every load takes below the highest common level that uses no more than n."""
    if n < 2 * len(loads):
        return [0] * len(loads)
    low, high = min(loads), max(loads) + n * each
    best = [0] * len(loads)
    for _ in range(100):
        mid = (low + high) / 2
        given = [max(0, int((mid - x) / each)) for x in loads]
        if sum(given) <= n:
            low, best = mid, given
        else:
            high = mid
    return best


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds nothing to docs but returns, per row: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text plus 1, a null text counting no bytes. Rows of equal text form a group and
    stay together; null texts form a group of their own, apart from empty ones. Equal sizes are settled by the text's
    digest, so the result depends on the rows alone. slot numbers the rows of a shard from 0 without gaps. Null and
    repeated doc_ids are kept as they are, one result row each; an empty table gives an empty result. Other columns of
    docs are not looked at.

    The driver sees one line for each class of group sizes (sizes rounded down to 16 leading bits), at most 2**16 plus
    2**15 for every doubling of size beyond 64 kB, whatever the number of rows; groups, texts and rows stay on the
    executors.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text.cast("binary")))).alias("key"),
        ),
        "shard-rows",
    )
    shift = F.greatest(F.length(F.bin("bytes")) - CLASS_BITS, F.lit(0)).cast("int")
    groups = written(
        slim.groupBy("key").agg(F.sum("size").alias("bytes"))
        .withColumn("__s", shift)
        .withColumn("class", F.expr("shiftleft(shiftright(bytes, __s), __s)")).drop("__s"),
        "shard-groups",
    )
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    found = [tuple(r) for r in classes.collect()]
    plan = [(c, sum(given), [sum(given[: i + 1]) for i in range(shards)]) for c, given in schedule(found, shards).items()]
    plan = spark.createDataFrame(plan, "class long, n long, cuts array<long>")
    placed = ranked(groups.join(plan, "class"), ["class"], ["key"], "n").select(
        "key", F.expr("size(filter(cuts, c -> c <= rank))").alias("shard")
    )
    rows = written(slim.join(placed, "key").drop("key"), "shard-placed")
    totals = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    order = [row_key(), F.col("size"), F.col("text_crc32")]
    return ranked(rows.join(totals, "shard"), ["shard"], order, "rows", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, near equal in bytes, equal texts together, and its slot there."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
