from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import simhash as s
from tests.llm.conftest import docs_of


def brute_print(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], radius: int = 3) -> list[int]:
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAbBzZÉé   \t\n\x0b\x1c.", max_size=60))
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_print(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, (1 << 12) - 1)), max_size=60))
def test_links_of_a_forest(items):
    items = sorted(set(items))
    group = np.array([g for g, _ in items], np.int64)
    prints = np.array([x for _, x in items], np.uint64)
    a, b, _ = s.local_links(group, prints)
    label = list(range(len(items)))
    for x, y in zip(a.tolist(), b.tolist()):
        label[x] = y
    expected = list(range(len(items)))
    for g in set(group.tolist()):
        rows = np.flatnonzero(group == g).tolist()
        for i, r in zip(rows, brute_components([int(prints[i]) for i in rows])):
            expected[i] = rows[r]
    assert label == expected


@pytest.mark.parametrize("tree, most", [(256, 200_000), (8, 200_000), (64, 20)])
def test_components_against_brute_force(spark, tree, most):
    """One bucket of all, small buckets under several masks, and buckets that are cut into trees and blocks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in np.repeat(base, 4)], np.uint64)
    prints = sorted(set(near.tolist()) | {0, (1 << 64) - 1, 7})
    df = spark.createDataFrame([(s._signed(x),) for x in prints], "fp long")
    found = {r[0]: r[1] for r in s.link_fingerprints(df, tree=tree, most=most).collect()}
    label = brute_components(prints)
    for i, x in enumerate(prints):
        same = [y for j, y in enumerate(prints) if label[j] == label[i]]
        assert (s._signed(x) in found) == (len(same) > 1)
        if len(same) > 1:
            assert found[s._signed(x)] == min(map(s._signed, same))


def test_masks():
    """Whatever three bits differ, two prints agree under a mask; masks hold as many bits as buckets of the size need."""
    for n in (1, 5_000, 300_000, 10**8, 10**10):
        masks = s.masks_for(n)
        for bits in itertools.combinations(range(0, 64, 3), 3):
            apart = sum(1 << b for b in bits)
            assert any(m & apart == 0 for m in masks)
        assert len({m.bit_count() for m in masks}) == 1 and n / 2 ** masks[0].bit_count() < 4 * s.TREE


def test_trees_hold_many_prints_and_are_pruned(spark):
    prints = np.unique(np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20_000))
    df = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    nodes, visited = s.tree_links(df).agg(F.sum("nodes"), F.sum("visited")).first()
    assert nodes == len(prints) * len(s.masks_for(len(prints)))
    per_tree = len(prints) / 2 ** s.masks_for(len(prints))[0].bit_count()
    assert per_tree >= s.TREE and visited < 0.7 * nodes * per_tree


def test_odd_rows(odd, none):
    found = [tuple(r) for r in s.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()]
    assert len(found) == odd.count()
    by = {r[0]: r for r in found}
    assert all(by[i][1:] == (0, 1) for i in (1, 2, 3))
    assert by[4][2] == by[5][2] == 4 and sum(r[0] == 4 for r in found) == 2
    assert by[None][2] is None
    assert s.near_duplicates(none).count() == 0


def test_hot_copies_and_chain(spark):
    """Many copies are one fingerprint; a chain of small steps is one component."""
    rows = [(i, "copy of one text that is everywhere in the corpus", "en", "s") for i in range(500)] + [(1000 + i, f"other text number {i} entirely {i * 7919}", "en", "s") for i in range(50)]
    found = s.near_duplicates(docs_of(spark, rows))
    assert found.where("component_id = 0").count() >= 500
    assert found.agg(F.countDistinct("doc_id")).first()[0] == 550
    chain = [0]
    for i in range(20):
        chain.append(chain[-1] | (0b111 << 3 * i))
    df = spark.createDataFrame([(s._signed(x),) for x in chain], "fp long")
    assert s.link_fingerprints(df).select("root").distinct().count() == 1
