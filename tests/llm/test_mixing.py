from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import mixing as m
from tests.llm.conftest import docs_of


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 3), max_size=6), st.integers(0, 200), st.sampled_from([0, 10, 16_384]))
def test_fit_against_all_choices(lengths, budget, exact):
    size, n = np.array(list(lengths), np.int64), np.array(list(lengths.values()), np.int64)
    take = m.fit(size, n, budget, exact)
    assert (take >= 0).all() and (take <= n).all()
    best = max(s for c in itertools.product(*[range(k + 1) for k in n]) if (s := int((np.array(c, np.int64) * size).sum())) <= max(budget, 0))
    assert int((take * size).sum()) == best


@pytest.mark.parametrize("size, n, budget, best", [([1, 2, 26], [2, 3, 2], 55, 55), ([3, 10], [3, 2], 20, 20), ([6, 10, 15], [40, 40, 40], 599, 599), ([1000, 1001], [10**6, 10**6], 10**9 + 7, 10**9 + 7), ([4, 6], [9, 9], 33, 32)])
def test_fit_takes_back_what_was_shared_out(size, n, budget, best):
    take = m.fit(np.array(size), np.array(n), budget)
    assert (take >= 0).all() and (take <= n).all() and int((take * size).sum()) == best


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, whole = total - sum(capped.values()), sum(weight[s] for s in free)
        out = {s: left * weight[s] / whole for s in free} | capped if whole else dict(capped)
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        capped |= {s: most * sizes[s] for s in over}


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sources = ["a", "Z", "é", "b", None, "𝄞"]
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", sources[int(rng.choice(6, p=[0.5, 0.1, 0.1, 0.15, 0.1, 0.05]))]) for i in range(800)]
    docs = docs_of(spark, rows)
    found = [r.asDict() for r in m.mix(docs).collect()]
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    aims = brute_targets(sizes)
    taken: dict = {}
    for r in found:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(aims[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - aims[s]) < 1 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in m.mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in found}


def test_odd_rows(odd, none):
    found = [r.asDict() for r in m.mix(odd).collect()]
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["size"] == by[i]["taken"] == 0 for i in (1, 2, 3))
    assert by[6]["size"] == 40_000 and by[7]["size"] == 1
    assert m.mix(none).count() == 0
