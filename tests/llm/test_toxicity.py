from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import toxicity as x
from tests.llm.conftest import docs_of

LABELS = "doc_id long, quality int, toxic int, text string"


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def corpus(n: int = 900):
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [words[j] for j in rng.integers(0, 300, rng.integers(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for w in ("idiot", "zorgon", "you"):  # one known word, one that must be learned
                text.insert(int(rng.integers(0, len(text))), w)
        rows.append((i, " ".join(text), "en", "s"))
        if i % 4 != 3:
            labels.append((i, 1, int(toxic), "noise"))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = docs_of(spark, rows)
    model = x.fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
    assert b"zorgon" in model.lexicon.learned
    scores = {r["doc_id"]: r["score"] for r in x.score_toxicity(docs, model).collect()}
    held = [i for i in scores if crc(i) % 3 == 1]
    assert all((scores[i] >= x.THRESHOLD) == (i % 6 == 0) for i in held)
    assert all(0 <= s <= 1 for s in scores.values())


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(300)
    docs = docs_of(spark, rows)
    turned = [(i, q, 1 - t if crc(i) % 3 == 1 else t, w) for i, q, t, w in labels]
    a, b = (x.fit_toxicity(docs, spark.createDataFrame(list_, LABELS)) for list_ in (labels, turned))
    assert a.lexicon.learned == b.lexicon.learned and (a.heights == b.heights).all() and (a.knots == b.knots).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 1)), min_size=1, max_size=25))
def test_isotonic_is_the_best_rising_fit(points):
    raw, y = np.array([float(a) for a, _ in points]), np.array([float(b) for _, b in points])
    knots, heights = x.isotonic(raw, y)
    fitted = np.interp(raw, knots, heights)
    assert (np.diff(heights) >= -1e-12).all()
    # least squares among rising functions: max over lower sets, min over upper sets of means
    for v in np.unique(raw):
        means = [[y[(raw >= a) & (raw <= b)].mean() for b in np.unique(raw) if b >= v] for a in np.unique(raw) if a <= v]
        assert fitted[raw == v][0] == pytest.approx(max(map(min, means)))


def test_trees_lower_the_loss():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(500, 4))
    y = ((data[:, 0] > 0.3) ^ (data[:, 1] > 0)).astype(float)
    p = 1 / (1 + np.exp(-x.Trees().fit(data, y).raw(data)))
    assert ((p > 0.5) == y).mean() > 0.97


def test_features_of_masked_and_addressed_words():
    lexicon = x.Lexicon({b"zorgon": 3.0})
    f = dict(zip(x.FEATURES, x.features("You are an 1d10t and a zorgon", lexicon)))
    assert f["unmasked_hits"] == 1 and f["near_second_person"] == 0 and f["log_learned"] > 0
    assert dict(zip(x.FEATURES, x.features("you zorgon", lexicon)))["near_second_person"] == 1
    assert x.features(None, lexicon) == x.features("", lexicon) == x.features(" \n", lexicon) == [0.0] * len(x.FEATURES)


def slow_features(text, lexicon) -> dict:
    """The features by regular expressions and loops."""
    data = (text or "").encode()
    words = [w.encode("latin-1") for w in re.findall(r"[a-z0-9\x80-\xff]+", data.decode("latin-1").translate({c: c + 32 for c in range(65, 91)}))]
    n, size = len(words), len(data)
    if not n:
        return dict.fromkeys(x.FEATURES, 0.0)
    raw = data.decode("latin-1")
    kind = "".join("a" if c.isascii() and c.isalpha() or ord(c) >= 128 else "1" if c in "0123456789$@!*_|+#%&" else " " if c in " \t\n\r\v\f" else "." for c in raw)
    overlap_free = lambda part: len(re.findall(re.escape(part), kind))
    weights = [lexicon.learned[w] for w in words if w in lexicon.learned]
    insults = [w for w in words if w in lexicon.insults]
    hits, second = [i for i, w in enumerate(words) if w in lexicon.all], [i for i, w in enumerate(words) if w in lexicon.second]
    unmasked = 0
    for w in re.findall(r"[^\x20\x09-\x0D]+", raw):
        shape = "".join("a" if c.isascii() and c.isalpha() or ord(c) >= 128 else "1" if c in "0123456789$@!*_|+#%&" else "." for c in w)
        if "1a" in shape or "a.a.a" in shape:
            plain = "".join(dict(zip("01345789$@!|+", "oieastbgsaiit")).get(c, c) for c in w.translate({c: c + 32 for c in range(65, 91)}))
            unmasked += plain.translate({ord(c): None for c in ".*_-#%&,;:\"'()"}).encode("latin-1") in lexicon.all
    near = sum(any(abs(i - j) <= x.NEAR for j in second) for i in hits)
    share = lambda test: sum(map(test, raw)) / size
    letters = share(lambda c: c.isascii() and c.isalpha() or ord(c) >= 128)
    masked = sum(overlap_free(p) for p in ("a1a", "a11a", "a.a.a"))
    values = (
        np.log1p(n), len(insults) / n, len(weights) / n, np.log1p(len(insults)), np.log1p(len(weights)), sum(weights), max(weights, default=0.0), masked / n,
        unmasked if masked or "1a" in kind else 0, near / len(hits) if hits else 0.0, len(second) / n, share(lambda c: "A" <= c <= "Z") / letters if letters else 0.0,
        share(lambda c: c in "!?"), share(lambda c: 33 <= ord(c) < 127 and not c.isalnum()), share(lambda c: c in "0123456789"), sum(overlap_free(p) for p in ("a1 ", " 1a")) / n, 1 - len(set(words)) / n,
    )
    return dict(zip(x.FEATURES, map(float, values)))


def slow_score(model, text) -> float:
    """Every tree walked split by split, then the line between the two knots around the sum."""
    f = list(slow_features(text, model.lexicon).values())
    raw = model.trees.start
    for splits, value in model.trees.trees:
        node = 0
        for feature, cut in splits:
            at = sum(edge < f[feature[node]] for edge in model.trees.edges[feature[node]])
            node = 2 * node + int(at > cut[node])
        raw += value[node]
    if raw <= model.knots[0]:
        return float(model.heights[0])
    for a, b, low, high in zip(model.knots, model.knots[1:], model.heights, model.heights[1:]):
        if raw <= b:
            return float(low + (high - low) * (raw - a) / (b - a))
    return float(model.heights[-1])


MASKED = ["You are an 1d10t!! and 2 m.o.r.o.n", "ÉTÉ s.t.u.p.i.d $tup1d  a1b2 _x_", "1 a", "!!!", "ID10T you", "naïve 'crap' you"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aAiIdotOyu1!$@*._ é\n'", max_size=40))
def test_features_against_loops(text):
    lexicon = x.Lexicon({b"aid": 2.0, b"you": 1.5})
    for t in (text, *MASKED):
        assert x.features(t, lexicon) == pytest.approx(list(slow_features(t, lexicon).values()))


def test_registered_query_against_brute_force(spark, tmp_path):
    """op7 over tables of its own: every score by loops over the model that it fits."""
    rows, labels = corpus(400)
    rows += [(5000 + i, t, "en", "s") for i, t in enumerate([*MASKED, None, "", "x" * 3000])] + [(None, "you idiot", "en", "s")]
    docs_of(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"]: r for r in x.op7_boosted_trees(spark, str(tmp_path)).collect()}
    model = x.fit_toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert len(found) == len(rows)
    for i, text, *_ in rows:
        r = found[i]
        assert r["score"] == pytest.approx(slow_score(model, text), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (i is not None and crc(i) % 3 == 1)


def test_halves_do_not_see_each_other(spark):
    rows, labels = corpus(300)
    sample = x.training_rows(docs_of(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    frame = lambda kept: spark.createDataFrame([(r["text"], r["toxic"], r["half"]) for r in kept], "text string, toxic int, half int")
    own = [x.learn_lexicons(frame([r for r in sample if r["half"] == h]))[h] for h in (0, 1)]
    assert x.learn_lexicons(frame(sample))[:2] == own and b"zorgon" in own[0] and b"zorgon" in own[1]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 1, "t"), (4, 1, None, "t"), (5, 1, 1, "t"), (6, 1, 0, "t"), (6, 1, 0, "t"), (10_000, 1, 1, "t")], LABELS)
    scores = x.score_toxicity(odd, x.fit_toxicity(odd, labels)).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    model = x.fit_toxicity(none, spark.createDataFrame([], LABELS))
    assert x.score_toxicity(none, model).count() == 0
    assert {r["score"] for r in x.score_toxicity(odd, model).collect()} == {0.0}
