from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import substrings as s
from tests.llm.conftest import docs_of


def brute(docs: list[tuple[int, bytes]], n: int = s.LENGTH) -> dict:
    seen, out = set(), {}
    for i, data in sorted(docs):
        cover = np.zeros(len(data) + 1, int)
        for p in range(len(data) - n + 1):
            part = data[p : p + n]
            if part in seen:
                cover[p] += 1
                cover[p + n] -= 1
            seen.add(part)
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out[i] = (len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone]))
    return out


def sort(batches, schema, *keys):
    batches = list(batches)
    if not batches:
        return None
    t = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys])
    return t.combine_chunks().to_batches()


def local(docs: list[tuple[int, bytes]]) -> dict:
    """The operator's steps, without Spark."""
    given_ = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1].decode("latin-1") for d in docs], pa.string())], ["id", "text"])
    rows = sort(s._contexts(iter([given_])), None, "bucket", "inner", "kind", "id", "start") or []
    found = [r for b in s._buckets(iter(rows)) for r in b.to_pylist()]
    asked: dict[int, list[int]] = {}
    spans: dict[int, list[int]] = {}
    for r in found:
        (asked if r["kind"] == s.ASK else spans).setdefault(r["id"], []).append(r["start"] * (256 if r["kind"] == s.ASK else 128) + r["more"])
    texts = dict(docs)
    todo = pa.RecordBatch.from_arrays([pa.array(list(asked), pa.int64()), pa.array([texts[i].decode("latin-1") for i in asked], pa.string()), pa.array(list(asked.values()), pa.list_(pa.int64()))], ["id", "text", "asked"])
    strings = sort(s._asked(iter([todo])), None, "bucket") or []
    for b in s._repeats(iter(strings)):
        for r in b.to_pylist():
            spans.setdefault(r["id"], []).append(r["start"] * 128 + r["more"])
    last = pa.RecordBatch.from_arrays([given_.column(0), given_.column(1), pa.array([spans.get(d[0]) for d in docs], pa.list_(pa.int64()))], ["doc_id", "text", "spans"])
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for b in s._cut(iter([last])) for r in b.to_pylist()}


PART = st.integers(0, 5).map(lambda i: (np.random.default_rng(i).integers(97, 123, 170, dtype=np.uint8)).tobytes())
CUT = st.tuples(PART, st.integers(0, 169), st.integers(0, 169)).map(lambda x: x[0][min(x[1:]) : max(x[1:])])
REPEAT = st.tuples(st.sampled_from([b"a", b"ab", b"abc "]), st.integers(1, 140)).map(lambda x: x[0] * x[1])
TEXT = st.lists(st.one_of(PART, CUT, REPEAT, st.binary(max_size=3).map(lambda b: bytes(c & 127 for c in b))), max_size=6).map(b"".join)


@pytest.mark.parametrize("hot", [False, True])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(TEXT, max_size=6))
def test_steps_against_brute_force(hot, texts):
    """With small pieces and, the second time, every anchor of several contexts taken as hot."""
    docs = list(enumerate(texts))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(s, "PIECE", 300)
        m.setattr(s, "ROWS", 7)
        if hot:
            m.setattr(s, "HOT_IN_PIECE", 1)
            m.setattr(s, "HOT_IN_ALL", 1)
        assert local(docs) == brute(docs)


def test_in_spark_against_brute_force(spark):
    rng = np.random.default_rng(5)
    shared = ["".join(chr(97 + c) for c in rng.integers(0, 26, 300)) for _ in range(4)]
    rows = []
    for i in range(60):
        own = "".join(chr(97 + c) for c in rng.integers(0, 26, 200))
        a, b = sorted(rng.integers(0, 300, 2))
        rows.append((int(i * 3 % 61), own[: rng.integers(0, 200)] + shared[i % 4][a:b] + own + (shared[0] if i % 5 == 0 else "é" * 60), "en", "s"))
    out = s.dedup_substrings(docs_of(spark, rows))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()}
    assert found == brute([(i, t.encode()) for i, t, *_ in rows])
    assert sum(r[1] for r in found.values()) > 0


def test_odd_rows(odd, none):
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in s.dedup_substrings(odd).collect()]
    assert len(found) == odd.count()
    by = {r[0]: r[1:] for r in found}
    assert by[1] == by[2] == (0, 0)
    assert by[6] == (200_000, 200_000 - 5)
    assert by[7][1] == 150_000 - 1
    assert by[4][1] == 0  # shorter than the strings that are compared
    assert s.dedup_substrings(none).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(150)) + "tail"
    out = s.dedup_substrings(docs_of(spark, [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, "en", "s")]))
    found = sorted((r["doc_id"], r["n_removed"]) for r in out.collect())
    assert found[0] == found[1] and found[2] == (2, len(text))


def test_different_texts_of_one_id_are_documents_of_their_own(spark):
    """Of one id and of none: unrelated, shorter and null texts, and strings at the same place in two of them."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared, edge = word(150), word(130)
    texts = [shared + word(90), shared + word(400), word(300), None, "short", word(20) + edge + word(70), word(20) + edge[10:125] + word(50)]
    rows = [(i, t) for i in (None, 4) for t in texts] + [(2, word(500) + shared), (5, edge + word(9)), (5, shared[:120]), (5, None)]
    rows += [(6, t) for t in (word(3) + edge[3:], word(700) + edge, shared[20:] + word(40))]
    out = s.dedup_substrings(docs_of(spark, [(i, t, "en", "s") for i, t in rows]))
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:4], bytes(r["kept"])) for r in out.collect())
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts + [t for _, t in rows]], "t string").selectExpr("t", "xxhash64(t) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, hashes[r[1]]))
    expected = brute([(k, (t or "").encode()) for k, (_, t) in enumerate(order)])
    assert found == sorted((i if i is not None else -1, *expected[k]) for k, (i, _) in enumerate(order))
