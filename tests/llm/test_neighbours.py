from __future__ import annotations

import math

import numpy as np
from pyspark.sql import types as T

from docweave.llm import neighbours as n

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("v", T.StringType()), T.StructField("leaf", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def exact(rows, every=20, k=20):
    """Every query row's nearest: (vec_id, [(vec_id, score)]); shorter vectors end in zeros, a null id sorts first."""
    rows = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in rows]).reshape(len(rows), width)
    ids = np.array([n.NULL_ID if i is None else i for i, _ in rows], np.int64)
    out = []
    for i in np.flatnonzero((ids != n.NULL_ID) & (ids % every == 0)):
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        if order:
            out.append((int(ids[i]), [(rows[j][0], float(score[j])) for j in order]))
    return sorted(out, key=repr)


def result(df):
    """The same of a result; the rows of a query come one after the other, so a rank of 1 begins another query row."""
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    found = []
    for q, rows in out.items():
        times = sum(r["rank"] == 1 for r in rows)
        assert times == 1, "several rows of one query id are compared by as_sets"
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        found.append((q, [(r["vec_id"], r["score"]) for r in rows]))
    return sorted(found, key=repr)


def lines(found):
    return sorted((q, rank, v, s) if v is not None else (q, rank, n.NULL_ID, s) for q, best in found for rank, (v, s) in enumerate(best, 1))


def recall(found, expected):
    best = dict(expected)
    assert {q for q, _ in found} == set(best) and all(len(b) == len(best[q]) for q, b in found)
    scores = {(q, v): s for q, b in expected for v, s in b}
    assert all(abs(scores.get((q, v), s) - s) < 1e-12 for q, b in found for v, s in b)
    return sum(len({v for v, _ in b} & {v for v, _ in best[q]}) for q, b in found) / sum(map(len, best.values()))


def test_recall_and_share_of_a_table_of_several_cells(spark):
    """Twice as many vectors as a cell holds, in groups: most neighbours are found among a small share of the rows."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(600, 24))
    rows = [(i, (centres[i % 600] * rng.uniform(0.8, 1.2) + rng.normal(size=24) * 0.4).tolist()) for i in range(2 * n.CELL)]
    df = n.nearest_vectors(frame(spark, rows), every=100).cache()
    assert recall(result(df), exact(rows, 100)) >= 0.9
    assert df.where("rank = 1").agg({"scored": "avg"}).first()[0] < 0.1 * len(rows)
    df.unpersist()


def test_recall_where_vectors_have_no_structure(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 32)))]
    df = n.nearest_vectors(frame(spark, rows)).cache()
    assert recall(result(df), exact(rows)) >= 0.9
    assert df.where("rank = 1").agg({"scored": "avg"}).first()[0] < len(rows) / 3
    df.unpersist()


def test_ties_copies_and_few_rows(spark):
    """With so few vectors that every leaf is visited, the result is exact: copies tie and go by vec_id."""
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(100)] + [(100 + i, [float(i), 1.0, 1.0]) for i in range(12)]
    assert result(n.nearest_vectors(frame(spark, rows))) == exact(rows)
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])]
    assert result(n.nearest_vectors(frame(spark, few))) == [(0, [(1, 0.5), (2, 0.5)])]


def test_more_copies_than_a_cell_holds(spark):
    rows = [(i, [1.0, 2.0]) for i in range(n.CELL + 100)] + [(20_000 + i, [float(i % 90), 1.0]) for i in range(n.CELL)]
    found = result(n.nearest_vectors(frame(spark, rows), every=1000))
    assert recall(found, exact(rows, 1000)) >= 0.9


def test_odd_rows(spark):
    """Ids that are null or come twice, and shorter vectors, take part; what has no direction or isn't finite doesn't."""
    good = [(i, [float(i % 7) + 1, 1.0]) for i in range(0, 12)] + [(200, [1.0, 2.0, 3.0]), (None, [1.0, 1.5]), (3, [4.0, 1.0]), (20, [9.0])]
    bad = [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (180, [None, 1.0]), (220, [])]
    assert result(n.nearest_vectors(frame(spark, good + bad))) == exact(good)
    twice = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 2.0]), (7, [1.0, 1.0])]
    found = [tuple(r)[:4] for r in n.nearest_vectors(frame(spark, twice)).collect()]
    assert sorted(found) == lines(exact(twice))
    assert n.nearest_vectors(frame(spark, [])).count() == 0
    assert n.nearest_vectors(frame(spark, bad[:2])).count() == 0
