from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import langid as g
from tests.llm.conftest import docs_of


def corpus(n: int = 400):
    rng = np.random.default_rng(6)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["é", "eau", "que", "re"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        words = ["".join(rng.choice(parts[lang], rng.integers(1, 4))) for _ in range(rng.integers(4, 60))]
        rows.append((i, " ".join(words), lang, "s"))
    return rows


def test_gradients_by_differences():
    """Backpropagation through time against small changes of every kind of parameter."""
    model = g.LanguageModel.fresh(["a", "b", "c"], hidden=3, seed=1)
    for part in (model.ahead, model.behind):
        part.byte, part.state, part.bias = (v.astype(np.float64) for v in (part.byte, part.state, part.bias))
    model.out, model.shift = model.out.astype(np.float64), model.shift.astype(np.float64)
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 103, (4, 5)), np.array([0, 1, 2, 1])
    _, grads = model.gradients(x, y)
    for part, grad in zip(model._parts(), grads):
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in part.shape)
            if part.shape[0] == 256:
                at = (int(x[rng.integers(0, 4), rng.integers(0, 5)]), at[1])
            old, eps = part[at], 1e-5
            part[at] = old + eps
            up = model.gradients(x, y)[0]
            part[at] = old - eps
            down = model.gradients(x, y)[0]
            part[at] = old
            assert grad[at] == pytest.approx((up - down) / (2 * eps), rel=1e-3, abs=1e-7)


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = docs_of(spark, rows)
    model = g.fit_languages(docs)
    found = {r["doc_id"]: r for r in g.identify(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([found[i]["lang_pred"] == rows[i][2] for i in held])
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def slow_states(cell: g.Cell, data: bytes) -> list[np.ndarray]:
    """A gated recurrent unit byte by byte, by its definition."""
    hid, out = cell.state.shape[0], []
    h = np.zeros(hid)
    for c in data:
        a, b = cell.byte[c].astype(float), h @ cell.state + cell.bias
        z, r = (1 / (1 + np.exp(-(a[i * hid : (i + 1) * hid] + b[i * hid : (i + 1) * hid]))) for i in (0, 1))
        h = (1 - z) * np.tanh(a[2 * hid :] + r * b[2 * hid :]) + z * h
        out.append(h)
    return out


def slow_prediction(model: g.LanguageModel, text: str | None) -> tuple[str, float]:
    data, total, n, at = (text or "").encode("utf-8"), np.zeros(len(model.languages)), 0, 0
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    while at < len(data):
        end = min(at + g.SPAN, len(data))
        begin = max(0, end - g.SPAN)  # the last span ends with the text
        span = data[begin:end]
        ahead, behind = slow_states(model.ahead, span), slow_states(model.behind, span[::-1])[::-1]
        for i in range(at - begin, len(span)):
            if span[i] >= 128 or chr(span[i]).isalpha():
                raw = np.concatenate((ahead[i], behind[i])) @ model.out + model.shift
                total += np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
                n += 1
        at = end
    return model.languages[int(total.argmax())], float(total.max() / n)


def test_whole_texts_are_read_across_words():
    model = g.LanguageModel.fresh(["a", "b", "c"], seed=3)
    texts = ["abc defgh abc " + "x" * 70, "é", "a b", None, "", "12 34", "wörter und " * 9, "a" * g.SPAN, "b" * (g.SPAN + 1)]
    langs, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        expected = slow_prediction(model, text)
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-5)
    x = np.random.default_rng(0).integers(0, 256, (5, 9))
    assert np.allclose(model.ahead.run(x), model.ahead.forward(x), atol=1e-6)


def test_registered_query_against_brute_force(spark, tmp_path):
    """op10 over tables of its own: every row by the slow network of the model that it trains, and the held-out rows right."""
    rows = corpus(160) + [(1000, None, "aa", "s"), (1001, "12 !", "bb", "s"), (None, "lo lo mi", "aa", "s")]
    docs_of(spark, rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = g.op10_byte_bigru(spark, str(tmp_path)).collect()
    model = g.fit_languages(docs)
    assert len(found) == len(rows)
    by, right = {r["doc_id"]: r for r in found}, []
    for i, text, lang, _ in rows:
        expected = slow_prediction(model, text)
        assert by[i]["lang_pred"] == expected[0] and by[i]["score"] == pytest.approx(expected[1], abs=1e-4)
        assert by[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if by[i]["held_out"] and i < 1000:
            right.append(by[i]["lang_pred"] == lang)
    assert np.mean(right) > 0.9


def test_what_is_learned_from(spark):
    rows = [(i, f"text {i}", "common" if i else "rare", "s") for i in range(300)] + [(400, "other", None, "s")]
    found = g.training_rows(docs_of(spark, rows), 20).collect()
    assert len(found) == 20 and "rare" in {r["lang"] for r in found}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["text"] == f"text {r['doc_id']}" for r in found)


def test_odd_rows(spark, odd, none):
    found = g.identify(odd, g.fit_languages(odd)).collect()
    assert len(found) == odd.count()
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert by[7]["lang_pred"] in ("en", "de", "fr")
    model = g.fit_languages(none)
    assert g.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in g.identify(odd, model).collect()} == {"und"}
