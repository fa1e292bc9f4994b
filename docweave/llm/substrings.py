"""Operator 9: removal of repeated 100-byte strings by bucket refinement over sampled suffixes.

Strings are told apart by hashes, of 128 bits within copies and of 64 bits and the bytes around at their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import blocks, row_key, table, written

LENGTH = 100
#: Bytes of an anchor; the strings of one anchor start in a run of at most LENGTH - GRAM + 1 positions.
GRAM = 24
#: Bytes of text that are looked at together, and the position bits that an anchor's order leaves room for.
PIECE = 1 << 20
_POS = 22
#: Different contexts of an anchor, in one piece of text or in all, from which the anchor counts as hot: its strings are
#: then spread one by one, so that no task gets them all.
HOT_IN_PIECE, HOT_IN_ALL = 64, 4096
#: Start positions that are compared together where the contexts of an anchor differ.
STEP = 8
#: Rows that are put in order together after the shuffle.
ROWS = 400_000

_MASK = np.uint64((1 << _POS) - 1)
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = {n: np.uint64(int(x) * 2 + 1) for n, x in zip((1, 2, 4, 8, 16, 32, 64, 3, 5), _RNG.integers(0, 1 << 62, 9))}

#: Kinds of rows: runs of strings to compare, signs that an anchor is hot, runs that go, runs to look into.
CONTEXT, MARK, GONE, ASK = 0, 1, 2, 3

ROW = "kind byte, bucket long, inner long, id long, start long, more int"
STRINGS = "bucket long, before long, after long, id long, start long, more int"


def _refine(left: np.ndarray, right: np.ndarray, level: int) -> np.ndarray:
    """Bucket ids of longer strings from the bucket ids at two offsets."""
    out = left * _ODD[level]
    out ^= out >> np.uint64(29)
    out += right
    return out


class Piece:
    """Bucket ids of the substrings of a stretch of bytes: those of 16 bytes everywhere, longer ones where asked."""

    def __init__(self, data: np.ndarray):
        ids = _BYTE[data]
        for n in (1, 2, 4, 8):
            ids = _refine(ids[:-n], ids[n:], n)
        self.b16 = ids

    def grams(self) -> np.ndarray:
        return _refine(self.b16[: -(GRAM - 16)], self.b16[GRAM - 16 :], 3)

    def strings(self, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Bucket ids of the `length` (64 to 128) bytes from each position, through those of 32 and 64 bytes."""
        b32 = lambda p: _refine(self.b16[p], self.b16[p + 16], 16)
        b64 = lambda p: _refine(b32(p), b32(p + 32), 32)
        return _mixed(_refine(b64(at), b64(at + length - 64), 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The strings that start at positions starts[i] to ends[i] (not included) of data, as runs of one anchor each.

    A string's anchor is its first GRAM-byte substring of the least bucket id. Returns the Piece and, for each run, the
    index into starts, its first and last position, its anchor's position and its anchor's bucket id.
    """
    piece = Piece(data)
    order = piece.grams()
    ids = _mixed(order)
    order = (ids & ~_MASK) | np.arange(len(ids), dtype=np.uint64)
    least = _sliding_min(order, LENGTH - GRAM + 1)
    count = ends - starts
    owner = np.repeat(np.arange(len(starts)), count)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    anchor = (least[pos] & _MASK).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(pos)])) - 1
    return piece, owner[at], pos[at], pos[last], anchor[at], ids[anchor[at]]


def _pieces(ids: list, texts: list, least: int = LENGTH):
    """Stretches of at most about PIECE bytes: (data, ids, offsets of the texts' starts, starts, ends) of whole or cut texts."""
    held, size = [], 0
    for i, data in zip(ids, texts):
        n = len(data) - least + 1
        for a in range(0, max(n, 0), PIECE):
            b = min(n, a + PIECE)
            if size and size + b - a + least > PIECE:
                yield held
                held, size = [], 0
            held.append((i, data, a, b))
            size += b - a + least - 1
    if held:
        yield held


def _row_batch(kind, bucket, inner, ids, start, more) -> pa.RecordBatch:
    cols = [pa.array(kind, pa.int8()), pa.array(bucket.view(np.int64)), pa.array(inner.view(np.int64)), pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(more, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, ["kind", "bucket", "inner", "id", "start", "more"])


def _later(ids: np.ndarray, start: np.ndarray, *keys: np.ndarray):
    """The rows in order of keys, id and start; flags for the first of each key; for those that start later than it.

    keys come with the least important one first. A row at its first's own place isn't later.
    """
    order = np.lexsort((start, ids, *keys))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    return order, new, (ids[order] != ids[first]) | (start[order] != start[first])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> a CONTEXT row for each run of strings with one anchor.

    bucket: the anchor's; inner: the refined bucket of all the bytes that the run's strings cover, with the anchor's
    place in them; start, more: the first start and how many more follow. Runs with the same bucket and inner hold the
    same strings in the same order. Of those that meet within a piece only the first goes on, the others are GONE. An
    anchor with very many different contexts in one piece sends a MARK, and ASK rows instead, dealt by document.
    """
    for batch in (part for whole in batches for part in blocks(whole, 1, 4 * PIECE)):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1).cast(pa.binary())]
        for held in _pieces(batch.column(0).to_pylist(), texts):
            parts = [np.frombuffer(d, np.uint8)[a : b + LENGTH - 1] for _, d, a, b in held]
            size = np.array([len(p) for p in parts], np.int64)
            begin = np.cumsum(size) - size
            piece, who, first, last, anchor, bucket = runs(np.concatenate(parts), begin, begin + size - LENGTH + 1)
            ids = np.array([h[0] for h in held], np.int64)[who]
            start, more = first - (begin - np.array([h[2] for h in held], np.int64))[who], last - first
            place = (anchor - first).astype(np.uint64) * np.uint64(128) + more.astype(np.uint64)
            inner = _mixed(piece.strings(first) * _ODD[4] + piece.strings(last) + place * _ODD[8])
            order, new, later = _later(ids, start, inner, bucket)
            kind = np.full(len(ids), -1, np.int8)
            kind[order[new]] = CONTEXT
            kind[order[later]] = GONE
            anchors, n = np.unique(bucket[order[new]], return_counts=True)
            hot = anchors[n > HOT_IN_PIECE]
            if len(hot):
                none = np.zeros(len(hot), np.int64)
                yield _row_batch(np.full(len(hot), MARK, np.int8), hot, none, none, none - 1, none)
                now = (kind == CONTEXT) & np.isin(bucket, hot)
                kind[now], more[now] = ASK, more[now] + 128
            away = kind >= ASK - 1
            bucket[away] = _mixed(ids[away].view(np.uint64))
            pick = kind >= 0
            yield _row_batch(kind[pick], bucket[pick], inner[pick], ids[pick], start[pick], more[pick])


def _by_bucket(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, some ROWS rows at a time, a bucket never cut."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= ROWS:
            cols = [np.concatenate(x) for x in zip(*held)]
            whole = np.flatnonzero(cols[column] != cols[column][-1])  # the last bucket may go on
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield [c[:cut] for c in cols]
            held, n = [[c[cut:] for c in cols]], 0
    if held and sum(len(h[0]) for h in held):
        yield [np.concatenate(x) for x in zip(*held)]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition -> GONE rows for runs that are held earlier, ASK rows for runs to look into.

    In a bucket, runs with the same inner as an earlier one are gone whole. If runs of several kinds share the bucket,
    the first of each kind may still share some of its strings with another kind; those are asked for, with 128 added
    to more if the anchor is hot.
    """
    for kind, bucket, inner, ids, start, more in _by_bucket(batches, 1):
        n = len(kind)
        new_bucket = np.ones(n, bool)
        new_bucket[1:] = bucket[1:] != bucket[:-1]
        new = new_bucket.copy()
        new[1:] |= (inner[1:] != inner[:-1]) | (kind[1:] != kind[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        number = np.cumsum(new_bucket) - 1
        context = kind == CONTEXT
        kinds = np.bincount(number[new & context], minlength=number[-1] + 1)
        marked = np.bincount(number[kind == MARK], minlength=number[-1] + 1) > 0
        ask = new & context & ((kinds > 1) | marked)[number]
        out = np.full(n, -1, np.int8)
        out[context & ((ids != ids[first]) | (start != start[first]))] = GONE
        out[kind >= ASK - 1] = kind[kind >= ASK - 1]
        out[ask] = ASK
        more = more + np.where(ask & ((kinds > HOT_IN_ALL) | marked)[number], 128, 0)
        pick = out >= 0
        yield _row_batch(out[pick], bucket[pick], inner[pick], ids[pick], start[pick], more[pick])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the runs asked for (start * 256 + more) -> STRINGS rows."""
    for batch in batches:
        todo, size = [], 0
        for i, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for x in sorted(asked):
                start, hot, more = x >> 8, x >> 7 & 1, x & 127
                todo.append((i, start, hot, data[start : start + more + LENGTH]))
                size += more + LENGTH
                if size > PIECE // 4:
                    yield from _strings_of(todo)
                    todo, size = [], 0
        if todo:
            yield from _strings_of(todo)


def _bytes(data: np.ndarray, at: np.ndarray, count: np.ndarray, way: int) -> np.ndarray:
    """Up to 7 bytes next to each position, the nearest in the lowest place."""
    out = np.zeros(len(at), np.int64)
    for i in range(STEP - 1):
        have = i < count
        out[have] |= data[at[have] + way * i].astype(np.int64) << 8 * i
    return out


def _strings_of(todo) -> Iterator[pa.RecordBatch]:
    """Runs -> rows for up to STEP neighbouring strings each, by their place before the anchor.

    All of such a row's strings hold the LENGTH - STEP + 1 bytes from its first multiple-of-STEP place on: the bucket is
    that core's. before and after are the bytes that some of them hold besides. more: 8 * the fewest bytes before the
    core that a string of the row has + the most. start is where the string with the most begins. A hot anchor's
    strings get rows and buckets of their own. Of equal rows only the first goes on; the others' strings are equal to
    it one by one, and they are told by a row of bucket 0.
    """
    size = np.array([len(t[3]) for t in todo], np.int64)
    begin = np.cumsum(size) - size
    data = np.concatenate([t[3] for t in todo])
    piece, who, first, last, anchor, gram = runs(data, begin, begin + size - LENGTH + 1)
    ids, start, hot = (np.array([t[k] for t in todo], np.int64)[who] for k in (0, 1, 2))
    shift = begin[who] - start
    low, high = anchor - last, anchor - first
    step = np.where(hot > 0, 1, STEP)
    n = high // step - low // step + 1
    row = np.repeat(np.arange(len(n)), n)
    part = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (low // step)[row]) * step[row]
    block = part // STEP * STEP
    fewest, most = np.maximum(part, low[row]) - block, np.minimum(part + step[row] - 1, high[row]) - block
    core = anchor[row] - block
    before = _bytes(data, core - 1, most, -1)
    after = _bytes(data, core + LENGTH - STEP + 1, STEP - 1 - fewest, 1)
    bucket = _mixed(piece.strings(core, LENGTH - STEP + 1) + gram[row] + block.astype(np.uint64) * _ODD[5])
    single = (hot > 0)[row]
    own = _mixed(_mixed(bucket + before.view(np.uint64) * _ODD[3]) + after.view(np.uint64) * _ODD[5] + most.astype(np.uint64))
    bucket = np.where(single, own, bucket) | np.uint64(1)
    more, begins = 8 * fewest + most, core - most - shift[row]
    order, new, later = _later(ids[row], begins, more, after, before, bucket)
    for rows, keep in ((order[new], True), (order[later], False)):
        at = bucket[rows].view(np.int64) if keep else np.zeros(len(rows), np.int64)
        cols = [at, before[rows], after[rows], ids[row][rows], begins[rows]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(more[rows], pa.int32())], ["bucket", "before", "after", "id", "start", "more"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRINGS rows sorted by bucket -> id, start, more of runs of strings that are held earlier."""

    def out(ids, start, more):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(more, pa.int32())], ["id", "start", "more"])

    for bucket, before, after, ids, start, more in _by_bucket(batches, 0):
        fewest, most = more >> 3, more & 7
        told = bucket == 0
        if told.any():
            yield out(ids[told], start[told], (most - fewest)[told])
        edge = np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))
        shared = ~told & ~(edge[:-1] & edge[1:])  # a bucket of one row has nothing to compare
        bucket, before, after, ids, start, fewest, most = (x[shared] for x in (bucket, before, after, ids, start, fewest, most))
        n = (most - fewest + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        back = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        k = most[row] - back
        left = before[row] & ((np.int64(1) << 8 * k.astype(np.int64)) - 1)
        right = after[row] & ((np.int64(1) << 8 * (STEP - 1 - k.astype(np.int64))) - 1)
        ids, start = ids[row], start[row] + back
        order, _, later = _later(ids, start, right, left, k, bucket[row])
        gone = order[later]
        yield out(ids[gone], start[gone], np.zeros(len(gone), np.int32))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in blocks(whole, 1, 2 * PIECE)):
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            data = text.as_py() or b""
            n, removed, n_spans = len(data), 0, 0
            if spans:
                spans = np.sort(np.array(spans, np.int64))
                a, b = spans >> 7, (spans >> 7) + (spans & 127) + LENGTH
                reach = np.maximum.accumulate(b)
                new = np.concatenate(([True], a[1:] > reach[:-1]))
                a, b = a[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]
                n_spans, removed = len(a), int((b - a).sum())
                data = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), n]))
            out.append((doc_id, n, removed, n_spans, data))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _numbered(texts: DataFrame) -> DataFrame:
    """texts (id, doc_id, text) with an id for each different text of an id, in order of id and XXH64 of the text.

    Where no id has two texts, which one grouped pass over ids and hashes tells, ids stay as they are.
    """
    texts = texts.withColumn("hash", F.xxhash64("text"))
    pairs = texts.select("id", "hash").groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
    if pairs.where("a <> b").isEmpty():
        return texts.drop("hash")
    ordered = texts.select("id", "hash").distinct().orderBy("id", "hash").withColumn("number", F.monotonically_increasing_id())
    ordered = written(ordered, "substring-ids")
    return texts.join(ordered, ["id", "hash"]).select(F.col("number").alias("id"), "doc_id", "text")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or earlier in the same
    document) goes; strings are judged on the input and never cross documents. A null text is empty. Rows of equal
    doc_id and text are taken as one document: a string at the same place in two of them isn't repeated by that. Rows
    of equal doc_id and different texts are documents of their own, in order of the texts' XXH64; so are rows of a null
    doc_id, which is smaller than all others and stays null. An empty table gives an empty result. Other columns are not looked at.

    Suffixes are sampled: a string belongs to the bucket of its anchor, its least GRAM-byte substring, so equal strings
    share a bucket, and strings that start side by side mostly share it too and go as one row. Buckets are refined by
    the buckets of later offsets, 16, 32, 64 and LENGTH bytes, each built from the one before. Rows that agree after
    refining hold the same strings. Only where a bucket holds several kinds of run (the edges of copies) it is refined
    again, by what a few neighbouring strings have in common, and those are compared byte by byte at their ends. Bucket
    ids are 64-bit hashes; runs count as equal if their anchors' ids and their refined ids agree, 128 bits in all,
    strings if their cores' ids and the bytes around do. No bucket is limited in size: rows that repeat are dropped
    before the shuffle, and the strings of anchors with very many contexts are spread one by one.
    """
    texts = docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = _numbered(texts)
    rows = texts.select("id", "text").mapInArrow(_contexts, ROW).repartition("bucket").sortWithinPartitions("bucket", "inner", "kind", "id", "start")
    found = written(rows.mapInArrow(_buckets, ROW).where(F.col("kind") >= GONE).drop("bucket", "inner"), "substring-runs")
    dealt = texts.repartition("id")
    asks = found.where(F.col("kind") == ASK).groupBy("id").agg(F.collect_list(F.col("start") * 256 + F.col("more")).alias("asked"))
    strings = dealt.join(asks, "id").select("id", "text", "asked").mapInArrow(_asked, STRINGS)
    dealt_to = F.when(F.col("bucket") == 0, F.xxhash64("id")).otherwise(F.col("bucket"))
    strings = strings.withColumn("to", dealt_to).repartition("to").sortWithinPartitions("bucket").drop("to")
    gone = strings.mapInArrow(_repeats, "id long, start long, more int")
    gone = gone.unionByName(found.where(F.col("kind") == GONE).drop("kind"))
    spans = gone.groupBy("id").agg(F.collect_list(F.col("start") * 128 + F.col("more")).alias("spans"))
    met = dealt.join(spans, "id", "left").select("doc_id", "text", "spans")
    return met.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes before and after repeated strings go, and a digest of what stays."""
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
