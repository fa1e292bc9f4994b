"""Operator 2: SimHash fingerprints and near-duplicate components through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import components, row_key, table, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a tree that buckets are cut to, on average; that one task takes into its trees, and one tree at most.
TREE, SHARD_ROWS = 256, 200_000
#: Pairs of a query and a tree node that a step of the search looks at, at most (or one query's).
STEP_PAIRS = 2_000_000
_HASH_BLOCK = 100_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' XXH64.

    Words are runs of anything but ASCII white space, with A-Z in lower case. A text of fewer words than a shingle is
    one shingle; a text without words has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _HASH_BLOCK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + _HASH_BLOCK)], last[at : at + _HASH_BLOCK])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], ["id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """id (a null doc_id as the smallest long), fp (the fingerprint's 64 bits as a signed long), text_hash: one row for each of docs."""
    rows = docs.select(row_key().alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "id long, fp long, text_hash long")


class BKForest:
    """One BK-tree for each group of fingerprints, all held in flat arrays.

    A tree's root is the first fingerprint of its group; every other one goes down from node to node along the edge
    labelled with its Hamming distance to the node, and becomes a child where no such edge is. All items of all trees
    go down one level at a time.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        """group: sorted group numbers of the items; prints: their fingerprints (uint64)."""
        self.prints = prints
        n = len(prints)
        self.first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
        self.root = np.repeat(self.first, np.diff(np.concatenate((self.first, [n]))))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left = np.flatnonzero(self.root != np.arange(n))
        node = self.root[left]
        while len(left):
            d = np.bitwise_count(prints[left] ^ prints[node]).astype(np.int64)
            order = np.lexsort((left, d, node))
            left, node, d = left[order], node[order], d[order]
            new = np.concatenate(([True], (node[1:] != node[:-1]) | (d[1:] != d[:-1])))
            child = left[new][np.cumsum(new) - 1]
            parent[left[new]], edge[left[new]] = node[new], d[new]
            left, node = left[~new], child[~new]
        self.visited = 0  #: nodes that searches have come to
        self.child = np.lexsort((edge, parent))
        self.child = self.child[parent[self.child] >= 0]
        # children lie side by side, by label: a range of labels is a range of positions
        self.key = parent[self.child] * 128 + edge[self.child]

    def within(self, prints: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in prints, node) at most radius apart below the roots given, following only edges d-radius..d+radius."""
        who, node = np.arange(len(prints)), roots
        found_who, found_node = [], []
        while len(who):
            self.visited += len(who)
            d = np.bitwise_count(prints[who] ^ self.prints[node]).astype(np.int64)
            near = d <= radius
            found_who.append(who[near])
            found_node.append(node[near])
            low = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.key, node * 128 + d + radius, "right")
            n = high - low
            who = np.repeat(who, n)
            at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            node = self.child[at]
        return np.concatenate(found_who or [who]), np.concatenate(found_node or [node])


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label with the classes of a and b made one, each named by its smallest member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def _found(forest: BKForest, label: np.ndarray, prints: np.ndarray, roots: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """label after prints (whose places in it are own) have asked the trees below roots, whose nodes come first in label."""
    size = np.diff(np.append(forest.first, len(forest.prints)))
    cost = np.cumsum(size[np.searchsorted(forest.first, roots)])
    at = 0
    while at < len(prints):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP_PAIRS, "right")))
        who, node = forest.within(prints[at:to], roots[at:to], radius)
        label = _join_labels(label, own[who + at], node)
        at = to
    return label


def local_links(group: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, int]:
    """A link from every item to the first item of its component, items of a group being linked within radius bits; nodes visited."""
    forest, items = BKForest(group, prints), np.arange(len(prints))
    label = _found(forest, items, prints, forest.root, items, radius)
    linked = np.flatnonzero(label != items)
    return linked, label[linked], forest.visited


LINKS = "u long, v long, nodes long, visited long"


def _links(u: np.ndarray, v: np.ndarray, nodes: int, visited: int) -> pd.DataFrame:
    """Links, and a row that links nothing and counts what finding them took."""
    return pd.DataFrame({"u": [*u, 0], "v": [*v, 0], "nodes": [0] * len(u) + [nodes], "visited": [0] * len(u) + [visited]}, dtype=np.int64)


def _shard_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole buckets -> the links that their trees find."""
    pdf = pdf.sort_values(["mask", "part", "fp"])
    new = (pdf["mask"].to_numpy()[1:] != pdf["mask"].to_numpy()[:-1]) | (pdf["part"].to_numpy()[1:] != pdf["part"].to_numpy()[:-1])
    prints = np.ascontiguousarray(pdf["fp"].to_numpy())
    a, b, visited = local_links(np.concatenate(([0], np.cumsum(new))), prints.view(np.uint64))
    return _links(prints[a], prints[b], len(prints), visited)


def _block_links(tree: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """A part of a large bucket as one tree, and a block of the bucket's fingerprints that ask it."""
    if not len(tree) or not len(asking):
        return _links(np.zeros(0), np.zeros(0), 0, 0)
    nodes, prints = np.sort(tree["fp"].to_numpy()), np.sort(asking["fp"].to_numpy())
    forest = BKForest(np.zeros(len(nodes), np.int64), nodes.view(np.uint64))
    both = np.concatenate((nodes, prints))
    label = _found(forest, np.arange(len(both)), prints.view(np.uint64), np.zeros(len(prints), np.int64), len(nodes) + np.arange(len(prints)), RADIUS)
    linked = np.flatnonzero(label != np.arange(len(both)))
    return _links(both[linked], both[label[linked]], len(nodes), forest.visited)


def masks_for(n: int, radius: int = RADIUS, tree: int = TREE) -> list[int]:
    """Masks of 64 bits such that prints within radius bits agree under one of them, and n random ones share `tree` to a bucket.

    The 64 bits are cut into blocks; radius of them at most can differ, so for each choice of the others two near prints
    agree there. As many of these bits count as make a bucket of the size wanted: few blocks do while prints are few.
    """
    wanted = max(0, (max(1, n) // tree).bit_length() - 1)
    if not wanted:
        return [0]
    blocks = radius + 1
    while 64 * (blocks - radius) // blocks < wanted and blocks < 2 * radius:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in combinations(range(blocks), blocks - radius):
        bits = [i for k in kept for i in range(cuts[k], cuts[k + 1])][:wanted]
        masks.append(sum(1 << i for i in bits))
    return masks


def tree_links(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, most: int = SHARD_ROWS) -> DataFrame:
    """fp (distinct, signed long) -> u, v: links whose components are those of all pairs at most radius bits apart; nodes, visited.

    Buckets under each mask (see masks_for) are dealt to shards by a hash; a shard builds a BK-tree of each of its buckets
    and asks it for every one of its fingerprints. A bucket of more than `most` is cut into trees of so many, each of which
    is asked by the bucket's fingerprints, block by block, so no task holds it whole. A bucket hands on stars, not its
    pairs: one link for each fingerprint and tree at most. Rows with u = v count: nodes of trees, and nodes visited.
    """
    n = prints.count()
    masks = masks_for(n, radius, tree)
    shards = max(1, -(-n * len(masks) // most))
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "part"))
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("mask", "part"), F.lit(shards)))
    large = written(keyed.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "simhash-large")
    if large.isEmpty():
        return keyed.groupBy("shard").applyInPandas(_shard_links, LINKS)
    large = large.withColumn("blocks", F.ceil(F.col("n") / most))
    links = keyed.join(large, ["mask", "part"], "left_anti").groupBy("shard").applyInPandas(_shard_links, LINKS)
    held = keyed.join(large, ["mask", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    trees, asking = held.select("mask", "part", "fp", F.col("own").alias("i"), every.alias("j")), held.select("mask", "part", F.col("fp").alias("fp"), every.alias("i"), F.col("own").alias("j"))
    keys = ["mask", "part", "i", "j"]
    asking = asking.select(*[F.col(c).alias(c) for c in ("mask", "part", "fp", "i", "j")])
    return links.unionByName(trees.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(_block_links, LINKS))


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, tree: int = TREE, most: int = SHARD_ROWS) -> DataFrame:
    """fp (distinct, signed long) -> fp, root: components of fingerprints at most radius bits apart; only those with a link."""
    links = written(tree_links(prints, radius, tree, most), "simhash-links")
    return components(links.select("u", "v")).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id, text_hash (XXH64 of the text, by which rows of one doc_id are told apart).

    Fingerprints link at RADIUS or fewer differing bits; component_id is the smallest doc_id that can be reached, the
    row's own included. Null, empty and blank texts have fingerprint 0 and link like any other. Rows of equal doc_id are
    rows on their own; a null doc_id counts as smaller than all others and stays null, also as a component_id. An empty
    table gives an empty result. Other columns of docs are not looked at.

    Copies share a fingerprint and are one row from then on (counted before the shuffle), however many there are.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-prints")
    roots = written(link_fingerprints(prints.select("fp")), "simhash-roots")
    named = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    plain = lambda c: F.nullif(F.col(c), F.lit(-(1 << 63)))
    return rows.join(named, "fp").select(plain("id").alias("doc_id"), "fp", plain("component").alias("component_id"), "text_hash")


def op2_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that its links lead to."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
