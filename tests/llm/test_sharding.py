from __future__ import annotations

import heapq
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import sharding as s
from tests.llm.conftest import docs_of


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 60)), max_size=30), st.integers(1, 8))
def test_schedule_is_longest_processing_time(classes, shards):
    """The same loads as taking every group by itself from the heap."""
    sizes = dict(classes)
    plan = s.schedule([(size, n, size * n) for size, n in sizes.items()], shards)
    loads = [0] * shards
    for size, given_ in plan.items():
        assert sum(given_) == sizes[size]
        for i, n in enumerate(given_):
            loads[i] += size * n
    heap = [0] * shards
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            heapq.heappush(heap, heapq.heappop(heap) + size)
    assert sorted(loads) == sorted(heap)


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def test_groups_sizes_and_slots(spark):
    rows = [(i, f"text {i % 40} " * (i % 13 + 1), "en", "s") for i in range(600)] + [(1000 + i, "copy " * 30, "en", "hot") for i in range(400)]
    docs = docs_of(spark, rows)
    found = _rows(s.shard_by_bytes(docs))
    texts = {i: t for i, t, *_ in rows}
    where: dict[str, set] = {}
    for doc_id, size, crc, shard, _ in found:
        data = texts[doc_id].encode()
        assert size == len(data) + 1 and crc == zlib.crc32(data)
        where.setdefault(texts[doc_id], set()).add(shard)
    assert len(found) == 1000 and all(len(x) == 1 for x in where.values())
    for shard in {r[3] for r in found}:
        assert sorted(r[4] for r in found if r[3] == shard) == list(range(sum(r[3] == shard for r in found)))
    bytes_ = Counter()
    for r in found:
        bytes_[r[3]] += r[1]
    groups = Counter()
    for r in found:
        groups[texts[r[0]]] += r[1]
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + size)
    assert sorted(bytes_.values()) == sorted(x for x in heap if x)
    assert sorted(found) == sorted(_rows(s.shard_by_bytes(docs.repartition(7))))


def test_ranks_of_split_classes(spark):
    from docweave.llm.common import ranked

    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").withColumn("n", F.when(F.col("k") == 2, 1666).otherwise(1667))
    found = ranked(df, ["k"], [F.col("id")], "n", block=100).collect()
    for k in range(3):
        ranks = sorted(r["rank"] for r in found if r["k"] == k)
        assert ranks == list(range(len(ranks)))
    whole = ranked(df, ["k"], [F.col("id")], "n").collect()  # one law, however a class is split
    assert sorted(map(tuple, whole)) == sorted(map(tuple, found))
    same = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") % 2).alias("id"), F.lit(300).alias("n"))
    found = ranked(same, ["k"], [F.col("id")], "n", block=50).collect()
    assert sorted(r["rank"] for r in found) == list(range(300)) and sum(r["id"] for r in found) == 150


def test_odd_rows(odd, none):
    found = _rows(s.shard_by_bytes(odd))
    assert len(found) == odd.count()
    by = {r[0]: r for r in found}
    assert by[1][1:3] == (1, 0) and by[2][1:3] == (1, 0)
    assert by[4][3] == by[5][3] and sum(r[0] == 4 for r in found) == 2
    assert None in by
    assert s.shard_by_bytes(none).count() == 0
