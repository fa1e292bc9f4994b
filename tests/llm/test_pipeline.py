from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from docweave.llm import toxicity as tox
from docweave.llm.pieces import Pieces
from tests.llm.conftest import ODD, docs_of
from tests.llm.test_linedup import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_similar import brute_similar
from tests.llm.test_toxicity import LABELS, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf_dir = f"file://{tmp_path_factory.mktemp('tables')}"
    rows, labels = corpus(240)
    rows, labels = [(i + 120, *r) for i, *r in rows], [(i + 120, *r) for i, *r in labels]
    shared = "\na line that very many documents of this corpus hold"
    rows = [(i, t + (shared if i % 5 == 0 else ""), lang, f"s{i % 4}") for i, t, lang, _ in rows]
    rows += [(1000 + i, rows[i][1], "en", "copies") for i in range(1, 60)] + [(2000 + i, rows[i][1] + " more", "en", "copies") for i in range(1, 60)] + [(i, *r) for i, *r in ODD]
    docs_of(spark, rows).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{sf_dir}/labels.parquet")
    return sf_dir


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_each_stage_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = rows_of(docs)
    toxic = pipe.toxicity(spark, docs, tables)
    assert toxic.columns == COLUMNS
    model = tox.fit_toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    score = lambda t: float(model.scores(tox.np.array([tox.features(t, model.lexicon)]))[0])
    kept = sorted((r for r in before if score(r[1]) < tox.THRESHOLD), key=str)
    assert sorted(rows_of(toxic), key=str) == kept and len(kept) < len(before)
    assert all(r[0] is None or r[0] >= 1000 or r[0] % 6 or r[0] < 120 for r in kept)

    lines = pipe.line_dedup(spark, toxic, tables)
    assert lines.columns == COLUMNS
    expected = sorted(((i, t) for i, _, _, t in brute_lines([(r[0], r[1]) for r in kept])), key=str)
    assert sorted(((r[0], r[1] or "") for r in rows_of(lines)), key=str) == expected
    assert all((r[1] is None and r[4] is None) or r[4] == len(r[1]) for r in rows_of(lines))

    near = pipe.near_dedup(spark, lines, tables)
    assert near.columns == COLUMNS
    held = rows_of(lines)
    ids = sorted({r[0] if r[0] is not None else -(1 << 63) for r in held})
    one = {i: next(r for r in held if (r[0] if r[0] is not None else -(1 << 63)) == i) for i in ids}
    label = brute_similar([one[i][1] for i in ids])
    least = sorted({label[j] for j in range(len(ids))})
    assert sorted(r[0] if r[0] is not None else -(1 << 63) for r in rows_of(near)) == [ids[j] for j in least]

    mixed = pipe.mixing(spark, near, tables)
    assert mixed.columns == COLUMNS
    sizes: dict = {}
    for r in rows_of(near):
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    taken: dict = {}
    for r in rows_of(mixed):
        taken[r[3]] = taken.get(r[3], 0) + len((r[1] or "").split())
    for source, aim in brute_targets(sizes).items():
        largest = max(len((r[1] or "").split()) for r in rows_of(near) if r[3] == source)
        assert abs(taken.get(source, 0) - aim) <= max(1, largest)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2

    last = pipe.sentencepiece(spark, mixed, tables)
    assert last.count() == mixed.count()
    pieces = Pieces.load()
    counts = {r["doc_id"]: r["n_pieces"] for r in last.collect()}
    assert all(counts[r[0]] == len(pieces.encode(r[1] or "")) for r in rows_of(mixed))


def test_run_writes_every_stage(spark, tables):
    out = pipe.run(spark, tables)
    assert out.where(~F.col("exact") & ~F.col("doc_id").eqNullSafe(9)).count() == 0
    assert out.count() > 0


def test_empty_tables(spark, tmp_path):
    sf_dir = f"file://{tmp_path}"
    docs_of(spark, []).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{sf_dir}/labels.parquet")
    assert pipe.run(spark, sf_dir).count() == 0


def test_near_dedup_by_group(spark):
    """Rows without an id, and rows of one id, that hold unrelated texts all stay; copies of them go."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (1, text(2)), (1, text(3)), (2, text(0) + " more"), (3, text(3)), (1, text(3)), (4, text(4)), (4, text(4) + " more"), (4, None), (5, "")]
    near = pipe.near_dedup(spark, docs_of(spark, [(i, t, "en", "s") for i, t in rows]), "")
    expected = [(None, text(0)), (None, text(1)), (1, text(2)), (1, text(3)), (4, text(4)), (4, None)]
    assert sorted(((r[0], r[1]) for r in rows_of(near)), key=str) == sorted(expected, key=str)


def test_mixing_of_rows_of_one_id(spark):
    """Each row gets its own times from the mix, not those of another row of its id."""
    rows = [(None if i % 2 else 7, " ".join(["w"] * (1 + i % 5)) + f" {i}", "en", f"s{i % 3}") for i in range(60)] + [(7, None, "en", None)]
    docs = docs_of(spark, rows)
    words: dict = {}
    for r in pipe.mix(docs).collect():
        words[r["source"]] = words.get(r["source"], 0) + r["taken"]
    mixed: dict = {}
    for r in rows_of(pipe.mixing(spark, docs, "")):
        mixed[r[3]] = mixed.get(r[3], 0) + len((r[1] or "").split())
    assert mixed == words
