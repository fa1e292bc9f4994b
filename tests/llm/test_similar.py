from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import similar as s
from tests.llm.conftest import docs_of


def shingles(text) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_similar(texts, least: float = 0.8) -> list[int]:
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= least * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def corpus(n: int = 160):
    """Texts, copies with a word or two changed (similar), and others of which half is new (not similar)."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    texts = [[word() for _ in range(int(rng.integers(80, 200)))] for _ in range(n // 4)]
    out = []
    for t in texts:
        near = [list(t), list(t)]
        for c in near:
            c[int(rng.integers(0, len(c)))] = word()
        half = t[: len(t) // 2] + [word() for _ in range(len(t) // 2)]
        out += [t, *near, half]
    return [" ".join(t) for t in out]


def test_against_exact_similarity(spark):
    texts = corpus()
    rows = [(i, t if i % 2 else t.upper(), "en", "s") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in s.similar_documents(docs_of(spark, rows)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_similar(texts)


def test_estimates():
    rng = np.random.default_rng(0)
    errors = []
    for share in np.linspace(0.5, 1, 40):
        a = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        b = a.copy()
        b[: int(600 * (1 - share))] = rng.integers(0, 1 << 63, int(600 * (1 - share)), dtype=np.uint64)
        d = int(s.distance(s.wide_print(a)[None], s.wide_print(b)[None])[0])
        cosine = np.cos(np.pi * d / (64 * s.LANES))
        errors.append(cosine - share)
    assert np.std(errors) < 0.03 and abs(np.mean(errors)) < 0.02
    assert s.radius_of(1.0) == 0 and s.radius_of(0.8) < s.radius_of(0.7)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 80), st.sampled_from([3, 300]))
def test_links_of_groups(seed, n, small):
    """Small groups go side by side, large ones by themselves: the same components as all pairs give."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, (max(1, n // 6), s.LANES), dtype=np.uint64)
    prints = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        prints[np.arange(n), rng.integers(0, s.LANES, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    group = np.sort(rng.integers(0, 3, n))
    old, s.SMALL = s.SMALL, small
    try:
        a, b = s.wide_links(group, prints, 5)
    finally:
        s.SMALL = old
    label = np.arange(n)
    label[a] = b
    expected = np.arange(n)
    for _ in range(n):
        for i in range(n):
            near = [j for j in range(n) if group[j] == group[i] and int(s.distance(prints[i][None], prints[j][None])[0]) <= 5]
            expected[i] = min(expected[j] for j in near)
    assert label.tolist() == expected.tolist()


def test_short_texts(spark):
    """Sets of few shingles are told apart nearly exactly."""
    rng = np.random.default_rng(9)
    texts = []
    for n in range(5, 100, 3):
        t = [f"w{int(x)}" for x in rng.integers(0, 10**9, n)]
        texts += [t, [*t, "more"], [*t, "quite", "some", "more"], t[:-1]]
    texts = [" ".join(t) for t in texts]
    found = {r["doc_id"]: r["component_id"] for r in s.similar_documents(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    expected = brute_similar(texts)
    assert sum(found[i] != expected[i] for i in range(len(texts))) <= 2


def test_odd_rows(odd, none):
    found = [tuple(r)[:2] for r in s.similar_documents(odd).collect()]
    assert len(found) == odd.count()
    by = dict(found)
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[None] is None
    assert s.similar_documents(none).count() == 0


def test_large_groups(spark):
    """More near copies than a tree takes side by side, and as many texts of half the words: two components."""
    words = [f"word{i}" for i in range(240)]
    rows = [(i, " ".join(words[:120]) + f" number {i}", "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(words[80:240]) + f" number {i}", "en", "s") for i in range(400)]
    found = {r["doc_id"]: r["component_id"] for r in s.similar_documents(docs_of(spark, rows)).collect()}
    assert all(found[i] == i // 1000 * 1000 for i in found)


def test_borderline_similarity(spark):
    """Pairs a little above and below the similarity, of more shingles than a bitmap takes: linked exactly as their sets say."""
    rng = np.random.default_rng(12)
    texts = []
    for i in range(160):
        n = int(rng.integers(100, 400))
        aim = 0.77 + 0.06 * i / 160
        same = int(round(2 * n * aim / (1 + aim))) + 4
        t = [f"w{int(x)}" for x in rng.integers(0, 10**9, 2 * n + 8 - same)]
        texts += [" ".join(t[: n + 4]), " ".join(t[:same] + t[n + 4 :])]
    expected = brute_similar(texts)
    assert 60 < sum(expected[i] != i for i in range(len(texts))) < 100
    found = {r["doc_id"]: r["component_id"] for r in s.similar_documents(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [found[i] for i in range(len(texts))] == expected
