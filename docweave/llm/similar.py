"""Near duplicates of a given similarity, for operator 2's general use: wide SimHash prints in BK-trees.

A 64-bit print with a radius of 3 bits tells little about texts that share four fifths of their shingles: such prints are
some ten bits apart. Here prints have 2048 bits, whose distance estimates the similarity to within about 0.02, and trees
are built where two texts share the least of their shingles under some of many orders. What is near by its prints is only
a candidate: texts link by the exact similarity of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import blocks, components, row_key, written
from docweave.llm.simhash import SEED, _join_labels

WORDS = 5
SIMILARITY = 0.8
#: Prints that one task takes into its trees, on average.
SHARD_ROWS = 100_000
LANES = 32
#: Bands of a text, and shingles that a band is made of: texts of similarity 0.8 share one with probability 0.9998.
BANDS, ROWS = 12, 3
#: By how many standard errors the distance of two candidates' prints may exceed what their similarity leads to expect.
ERRORS = 5
BLOCK = 2 << 20
#: Bytes of candidates' texts that one task compares, on average; shingles, and at first pairs, that are compared at once.
EXACT_BYTES, SHINGLES, FIRST_PAIRS = 8 << 20, 1 << 20, 1024
#: Sets of few shingles are held as a bitmap instead, whose distance counts the shingles that two sets don't share. Sizes
#: between FEW and MANY have both forms: sets on either side of them can't be similar.
FEW, MANY = 52, 80
#: Trees of at most so many prints are searched side by side; pairs that are compared at once.
SMALL, PAIRS = 256, 200_000

_RNG = np.random.default_rng(1024)
_LANE = _RNG.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_of(similarity: float, bits: int = 64 * LANES) -> int:
    """The distance of prints of two equally large sets of that Jaccard similarity: its cosine is 2 s / (1 + s)."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def candidate_radius(similarity: float, bits: int = 64 * LANES) -> int:
    """The distance that prints of two sets of that similarity hardly ever exceed; at equal sizes they are farthest apart."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + ERRORS * math.sqrt(bits * share * (1 - share)))


def shingle_hashes(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles; fewer words than a shingle are one."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """2048 bits, each 1 if set in over half of the shingles' hashes, of which every lane mixes its own."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255, None]
        mixed = (h ^ (h >> np.uint64(29))) * _LANE
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)  # 255 rows: no sum overflows
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """2048 bits, those set that the shingles' hashes fall on."""
    bits = np.zeros(64 * LANES, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(64 * LANES)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _text_hashes(text: str | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return words, shingle_hashes(words) if words else np.zeros(1, np.uint64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in blocks(whole, 1, BLOCK)):
        texts, hashes = zip(*map(_text_hashes, batch.column(1).to_pylist()))
        starts = np.cumsum([0] + [len(h) for h in hashes])[:-1]
        flat = np.concatenate(hashes)
        least = np.stack([np.minimum.reduceat((flat ^ (flat >> np.uint64(32))) * m, starts) for m in _ORDER], axis=1)
        keys = least.reshape(len(texts), BANDS, ROWS)
        bands = keys[:, :, 0].copy()
        for i in range(1, ROWS):
            bands = (bands ^ (bands >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, i]
        nodes = [xxhash.xxh64_intdigest(b" ".join(w), 1) for w in texts]
        forms = [[bitmap(h).tobytes() if len(h) <= MANY else None, wide_print(h).tobytes() if len(h) > FEW else None] for h in hashes]
        offsets = pa.array(np.arange(0, BANDS * len(texts) + 1, BANDS), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(forms, pa.list_(pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64)))],
            ["id", "text_hash", "node", "forms", "bands"],
        )


class Sets:
    """Sets of shingles, by their sorted hashes, and which of them are similar."""

    def __init__(self, hashes: list[np.ndarray], similarity: float):
        self.similarity, self.size = similarity, np.array([len(h) for h in hashes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        ids = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int64)
        self.width = int(ids.max()) + 1
        self.keys = np.repeat(np.arange(len(hashes)), self.size) * self.width + ids

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity of the sets a and b (positions) is at least what is asked for."""
        n, m = self.size[a], self.size[b]
        out = np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9
        todo = np.flatnonzero(out)
        total = np.cumsum(n[todo])
        at = 0
        while at < len(todo):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SHINGLES, "right")))
            pair = todo[at:to]
            k, ends = n[pair], np.cumsum(n[pair])
            own = np.arange(ends[-1]) + np.repeat(self.begin[a[pair]] - (ends - k), k)
            keys = self.keys[own] + np.repeat((b[pair] - a[pair]) * self.width, k)
            held = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys
            shared = np.add.reduceat(held, ends - k, dtype=np.int64)
            out[pair] = shared >= self.similarity * (k + m[pair] - shared) - 1e-9
            at = to
        return out


class Near:
    """Prints at most radius bits apart are near. They link by that or, if the sets are given, if those are similar."""

    def __init__(self, prints: np.ndarray, radius: int, sets: Sets | None = None):
        self.prints, self.radius, self.sets = prints, radius, sets

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits between the prints a and b (positions)."""
        return np.concatenate([distance(self.prints[a[i : i + PAIRS]], self.prints[b[i : i + PAIRS]]) for i in range(0, max(len(a), 1), PAIRS)])

    def join(self, label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """label, with the components of the near prints a and b joined if they link. Pairs of one component need no test."""
        if self.sets is None:
            return _join_labels(label, a, b)
        step = FIRST_PAIRS
        while True:
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return label
            link = self.sets.similar(a[:step], b[:step])
            label = _join_labels(label, a[:step][link], b[:step][link])
            a, b, step = a[step:], b[step:], step * 2


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class WideForest:
    """BK-trees over some of the prints, one for each group; children by Hamming distance to the parent."""

    def __init__(self, near: Near, items: np.ndarray, group: np.ndarray):
        """items: positions of the prints; group: their groups, sorted."""
        self.near, n = near, len(items)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        self.items, self.root = items, np.repeat(first, np.diff(np.append(first, n)))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left = np.flatnonzero(self.root != np.arange(n))
        node = self.root[left]
        while len(left):
            d = near.distance(items[left], items[node])
            order = np.lexsort((left, d, node))
            left, node, d = left[order], node[order], d[order]
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (d[1:] != d[:-1])))
            child = left[new][np.cumsum(new) - 1]
            parent[left[new]], edge[left[new]] = node[new], d[new]
            left, node = left[~new], child[~new]
        self.child = np.lexsort((edge, parent))
        self.child = self.child[parent[self.child] >= 0]
        self.key = parent[self.child] * 8192 + edge[self.child]

    def within(self, queries: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of near prints, below the roots given; only edges d - radius to d + radius are followed."""
        who, node, found, radius = queries, roots, [], self.near.radius
        while len(who):
            d = self.near.distance(who, self.items[node])
            hit = d <= radius
            found.append((who[hit], self.items[node[hit]]))
            low = np.searchsorted(self.key, node * 8192 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.key, node * 8192 + np.minimum(d + radius, 8191), "right") - low
            who = np.repeat(who, n)
            node = self.child[np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (who, node)


def _large(near: Near, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label, with the components of one large group joined.

    Prints that lead those without a component yet are compared with all of the group; what then is outside of the
    largest component goes into a tree, which all prints are asked against. Two prints of one component need no
    comparison, so a large group of copies costs no square of its size.
    """
    todo = np.ones(len(rows), bool)
    for _ in range(64):
        if not todo.any():
            break
        lead = np.full(len(rows), rows[np.argmax(todo)])
        hit = near.distance(lead, rows) <= near.radius
        label = near.join(label, lead[hit], rows[hit])
        todo &= label[rows] != label[lead]
    names, n = np.unique(label[rows], return_counts=True)
    outside = rows[label[rows] != names[n.argmax()]]
    if len(outside):
        forest = WideForest(near, outside, np.zeros(len(outside), np.int64))
        step = max(1, PAIRS // len(outside))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            label = near.join(label, *forest.within(part, np.zeros(len(part), np.int64)))
    return label


def _groups(near: Near, items: np.ndarray, group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """label, with the components of every group joined; items: positions of the prints; group: their groups, sorted."""
    if not len(items):
        return label
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(items)))
    apart = np.minimum.reduceat(label[items], first) != np.maximum.reduceat(label[items], first)
    large = apart & (size > SMALL)
    for a, k in zip(first[large].tolist(), size[large].tolist()):
        label = _large(near, items[a : a + k], label)
    small = np.flatnonzero(np.repeat(apart & (size <= SMALL), size))
    if len(small):
        forest = WideForest(near, items[small], group[small])
        step = max(1, PAIRS // SMALL)
        for at in range(0, len(small), step):
            a, b = forest.within(forest.items[at : at + step], forest.root[at : at + step])
            label = near.join(label, a[a < b], b[a < b])  # the other way round a pair comes again
    return label


def wide_links(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from every print to the first of its component, components being within sorted groups."""
    label = _groups(Near(prints, radius), np.arange(len(prints)), group, np.arange(len(prints)))
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return linked, label[linked]


def _radii(similarity: float) -> tuple[int, int]:
    """The distances that bitmaps never and prints hardly ever exceed if their sets are similar."""
    return int(2 * MANY * (1 - similarity) / (1 + similarity) + 1e-9), candidate_radius(similarity)


def _shard(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for form, part in pdf.groupby("form"):
            part = part.sort_values(["band", "key", "node"])
            band, key, node = (part[c].to_numpy() for c in ("band", "key", "node"))
            new = np.concatenate(([True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])))
            prints = np.frombuffer(b"".join(part["fp"]), np.uint64).reshape(-1, LANES)
            a, b = wide_links(np.cumsum(new), prints, _radii(similarity)[form])
            found.append(pd.DataFrame({"u": node[a], "v": node[b]}))
        return pd.concat(found)

    return run


def _exact(similarity: float):
    """Texts of whole components of candidates -> the components that the similar ones among them make."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, bands = pdf["node"].to_numpy(), np.stack(pdf["bands"].to_list())
        sets = Sets([_text_hashes(t)[1] for t in pdf["text"]], similarity)
        label = np.arange(len(node))
        for form, radius in enumerate(_radii(similarity)):
            forms = [f[form] for f in pdf["forms"]]
            rows = np.flatnonzero([f is not None for f in forms])
            prints = np.zeros((len(node), LANES), np.uint64)
            prints[rows] = np.frombuffer(b"".join(forms[i] for i in rows), np.uint64).reshape(-1, LANES)
            near = Near(prints, radius, sets)
            for keys in bands[rows].T:
                order = np.argsort(keys, kind="stable")
                label = _groups(near, rows[order], keys[order], label)
        return pd.DataFrame({"node": node, "root": node[label]})

    return run


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, component_id, text_hash (XXH64 of the text), root: groups of near duplicates.

    Two texts link if the Jaccard similarity of their sets of five-word shingles (A-Z in lower case, words as runs of
    anything but ASCII white space) is at least `similarity`. Candidates are pairs that share a band and whose prints are
    at most ERRORS standard errors farther apart than such texts are; their sets (as 64-bit hashes) are then compared
    exactly, but for pairs that other links have made one component already. component_id is
    the smallest doc_id that can be reached; root names the group, also where groups have the same smallest doc_id. Texts of the same words are one from the start, so copies are counted
    before any shuffle. Texts without words link with each other. Rows of equal doc_id are rows on their own; a null
    doc_id is smaller than all others and stays null. An empty table gives an empty result. Other columns of docs are
    not looked at.

    Candidates are joined to components by their prints first; a component's texts, and only these, then go to one task.
    """
    texts = docs.select(row_key().alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = written(texts.mapInArrow(_rows, "id long, text_hash long, node long, forms array<binary>, bands array<long>"), "similar-rows")
    # prints and bands are functions of the words, as the node is: any row's will do
    nodes = written(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("forms").alias("forms"), F.first("bands").alias("bands")), "similar-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written(keyed.join(shared, ["band", "key"], "left_semi"), "similar-keys")
    shards = max(1, -(-met.count() // SHARD_ROWS))
    dealt = met.join(nodes.select("node", "forms"), "node").select("node", "band", "key", F.posexplode("forms").alias("form", "fp")).where(F.col("fp").isNotNull())
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("form", "band", "key"), F.lit(shards)))
    links = written(dealt.groupBy("shard").applyInPandas(_shard(similarity), "u long, v long"), "similar-links")
    met = written(components(links).select("node", F.col("root").alias("dealt")), "similar-met")
    wanted = written(nodes.join(met, "node").select("node", "dealt", "text_hash"), "similar-wanted")
    text = texts.join(wanted, "text_hash").groupBy("node", "dealt").agg(F.first("text").alias("text"))
    asked = written(text.join(nodes.select("node", "forms", "bands"), "node"), "similar-texts")
    tasks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // EXACT_BYTES))
    asked = asked.withColumn("task", F.pmod(F.xxhash64("dealt"), F.lit(tasks))).drop("dealt")
    roots = written(asked.groupBy("task").applyInPandas(_exact(similarity), "node long, root long"), "similar-roots")
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("node", "component", "root")
    plain = lambda c: F.nullif(F.col(c), F.lit(-(1 << 63)))
    return rows.join(named, "node").select(plain("id").alias("doc_id"), plain("component").alias("component_id"), "text_hash", "root")
