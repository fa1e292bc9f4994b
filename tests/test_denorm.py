from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.config import load
from docweave.plans import denorm
from docweave.plans.schema import document_schema, drifted, paths, schema_diff
from docweave.sources.registry import Sources

CONFIG = load(
    """
resources:
  - type: a
    fields: [{name: name, query: {search: primary}}, {name: tags, query: {search: primary}}, {name: note, type: text, query: {search: secondary}}, {name: n, type: long}, {name: gone}]
    relations:
      - {resource: d, cardinality: one, join: {local: c_id, from: c, foreign: id}, fields: [{name: x, query: {search: primary}}]}
      - {resource: b, join: {local: id, foreign: a_id}, fields: [{name: x, query: {search: secondary}}, {name: y, type: integer}]}
      - {resource: c, cardinality: one, join: {local: c_id, foreign: id}, fields: [{name: x}]}
  - type: b
    fields: [{name: x, query: {search: primary}}, {name: y, type: integer}, {name: a_id}]
  - type: c
    fields: [{name: x, query: {search: primary}}]
  - type: d
    fields: [{name: x, query: {search: primary}}]
"""
)


@pytest.fixture(scope="module")
def sources(spark):
    s = Sources(spark)
    s.add("a", spark.createDataFrame([(1, "one", ["t", "", None], "note", "12", "c1"), (2, "", [], None, "x", ""), (3, None, None, "n3", None, "none")], "id int, name string, tags array<string>, note string, n string, c_id string"))
    s.add("b", spark.createDataFrame([("b2", "x2", 2, "1"), ("b1", "x1", 1, "1"), ("b3", None, 3, "2"), ("b4", "zz", 4, ""), ("b5", "zz", 5, None)], "id string, x string, y int, a_id string"))
    s.add("c", spark.createDataFrame([("c1", "cx", "d1")], "id string, x string, c_id string"))
    s.add("d", spark.createDataFrame([("d1", "dx"), ("d1", "again")], "id string, x string"))
    return s


@pytest.fixture(scope="module")
def docs(sources):
    return {r["id"]: r.asDict(True) for r in denorm.documents(CONFIG, sources, "a").collect()}


def test_fields_and_relations(docs):
    assert docs["1"]["fields"] == {"name": "one", "tags": ["t", "", None], "note": "note", "n": 12, "gone": None}
    assert docs["1"]["b"] == [{"id": "b1", "x": "x1", "y": 1}, {"id": "b2", "x": "x2", "y": 2}]
    assert docs["1"]["c"] == {"id": "c1", "x": "cx"} and docs["3"]["c"] is None
    assert docs["3"]["b"] == [] and docs["2"]["fields"]["n"] is None


def test_chained_join_takes_the_first_row(docs):
    assert docs["1"]["d"] == {"id": "d1", "x": "again"}  # of rows with one id the least
    assert docs["2"]["d"] is None and docs["3"]["d"] is None


def test_surfaces(docs):
    assert docs["1"]["search_primary"] == ["one", "t", "", "again"]
    assert docs["2"]["search_primary"] is None and docs["2"]["search_secondary"] is None
    assert [e["text"] for e in docs["1"]["search_secondary"]] == [["note"], ["x1"], ["x2"]]
    assert all(e["scope"] == [] for e in docs["1"]["search_secondary"])


def test_asked_ids(spark, sources):
    ids = spark.createDataFrame([("3",), ("9",), ("3",)], "id string")
    found = {r["id"]: (r["found"], r["resource_id"]) for r in denorm.documents(CONFIG, sources, "a", ids=ids).collect()}
    assert found == {"3": (True, "3"), "9": (False, None)}


def test_edges_and_parents(spark, sources):
    built = denorm.documents(CONFIG, sources, "a")
    found = {r["id"]: sorted(map(tuple, r["children"])) for r in denorm.edges(CONFIG, built, "a").collect()}
    assert found == {"1": [("b", "b1"), ("b", "b2"), ("c", "c1"), ("d", "d1")], "2": [("b", "b3")], "3": []}
    ids = spark.createDataFrame([("b1",), ("b2",), ("b4",), ("b5",)], "id string")
    assert [tuple(r) for r in denorm.parents_of(CONFIG, sources, "b", ids).collect()] == [("a", "1")]
    assert denorm.parents_of(CONFIG, sources, "c", ids).isEmpty()


def test_source_pages_and_related_rows(spark, sources):
    assert [r["id"] for r in sources.after("b", "b2", 2).collect()] == ["b3", "b4"]
    keys = spark.createDataFrame([("1",)], "key string")
    assert {r["id"] for r in sources.related("b", "a_id", keys).collect()} == {"b1", "b2"}


def test_schema_follows_the_configuration(spark, sources):
    schema = document_schema(CONFIG.resource("a").version())
    assert ("b", "nested") in paths(schema) and ("c", "object") in paths(schema) and ("fields.n", "long") in paths(schema)
    built = denorm.documents(CONFIG, sources, "a").drop("id", "found")
    assert [f.name for f in built.schema] == [f.name for f in schema if f.name != "search_secondary"] + ["search_secondary"]
    other = document_schema(load("resources: [{type: a, fields: [{name: name, type: text, query: {search: primary}}, {name: new}]}]").resource("a").version())
    diff = schema_diff(spark, other, schema)
    assert {(r["path"], r["change"]) for r in diff.collect()} >= {("fields.name", "changed"), ("fields.new", "added"), ("b", "removed")}
    assert drifted(diff) and not drifted(schema_diff(spark, schema, schema))


def test_filters_reach_the_scan(spark, tmp_path):
    """A filter on a root field is pushed into the Parquet scan, and only the columns that count are read."""
    path = f"file://{tmp_path}/a"
    spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("x"), F.lit("unused").alias("unused")).write.parquet(path)
    s = Sources(spark).add("c", lambda: spark.read.parquet(path))
    plan = denorm.documents(CONFIG, s, "c").where(F.col("fields.x") == "x").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(x,x)" in plan and "unused" not in plan
