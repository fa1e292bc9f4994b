"""References that more children match than the old ceiling of 10,000 allowed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from docweave import catalog
from docweave.config import load
from docweave.errors import InvalidArgument
from docweave.functions.predicates import Filter
from docweave.operators.search import Searcher, SearchRequest
from docweave.plans.denorm import documents
from docweave.plans.schema import document_schema
from docweave.sources.registry import Sources

CONFIG = load(
    """
resources:
  - type: order
    fields: [{name: status, query: {search: primary}}, {name: cust_id}]
    relations:
      - {resource: customer, strategy: reference, join: {local: cust_id, foreign: id}, fields: [{name: segment}]}
      - {resource: label, strategy: reference, join: {local: id, foreign: order_id}, fields: [{name: toxic, type: integer}]}
  - type: line
    fields: [{name: flag, query: {search: primary}}, {name: order_id}]
    relations:
      - {resource: order, cardinality: one, join: {local: order_id, foreign: id}, fields: [{name: cust_id}]}
      - {resource: customer, strategy: reference, join: {local: cust_id, from: order, foreign: id}, fields: [{name: segment}]}
  - type: customer
    fields: [{name: segment, query: {search: primary}}]
  - type: label
    fields: [{name: order_id, query: {search: primary}}, {name: toxic, type: integer}]
"""
)

CHILDREN = 10_500


@pytest.fixture(scope="module")
def search(spark):
    """Customers and labels numbered from 0, those below CHILDREN matching; orders and lines for every hundredth number."""
    s, n = Sources(spark), F.col("n").cast("string")
    numbers = spark.range(12_000).withColumnRenamed("id", "n")
    few = numbers.where("n % 100 = 0")
    s.add("customer", numbers.select(n.alias("id"), F.when(F.col("n") < CHILDREN, "BUILDING").otherwise("OTHER").alias("segment")))
    s.add("label", numbers.select(F.concat(F.lit("l"), n).alias("id"), n.alias("order_id"), (F.col("n") < CHILDREN).cast("int").alias("toxic")))
    s.add("order", few.select(n.alias("id"), F.lit("O").alias("status"), n.alias("cust_id")))
    s.add("line", few.select(F.concat(n, F.lit("-1")).alias("id"), F.lit("R").alias("flag"), n.alias("order_id")))
    return Searcher(CONFIG, lambda r: documents(CONFIG, s, r), lambda r: spark.createDataFrame([], document_schema(CONFIG.resource(r).version())))


def ids(search, resource, *filters):
    return sorted(r["id"] for r in search.matches(SearchRequest(resource, filters=filters)).select("id").collect())


def test_all_children_of_a_reference_by_a_sibling(search):
    assert ids(search, "line", Filter("customer.segment", "eq", "BUILDING")) == sorted(f"{i}-1" for i in range(0, CHILDREN, 100))


def test_all_children_of_a_reference_by_id(search):
    assert ids(search, "order", Filter("customer.segment", "eq", "BUILDING")) == sorted(str(i) for i in range(0, CHILDREN, 100))


def test_all_children_of_a_reference_by_a_field(search):
    assert ids(search, "order", Filter("label.toxic", "eq", "1")) == sorted(str(i) for i in range(0, CHILDREN, 100))


def test_only_a_ceiling_that_was_asked_for_refuses(search):
    """No ceiling is set where none was given; one counts all children that match, not a part of them."""
    assert search.ceiling is None
    for ceiling, refused in ((CHILDREN - 1, True), (CHILDREN, False)):
        limited = Searcher(search.config, search.read, search.empty, ceiling=ceiling)
        if refused:
            with pytest.raises(InvalidArgument):
                ids(limited, "order", Filter("customer.segment", "eq", "BUILDING"))
        else:
            assert len(ids(limited, "order", Filter("customer.segment", "eq", "BUILDING"))) == CHILDREN // 100


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The smallest sample tables, but with 15,000 customers and 12,000 labels, most of which match."""
    if not os.path.isdir(SF):
        pytest.skip("the sample tables aren't here")
    base = str(tmp_path_factory.mktemp("many"))
    read, key = lambda t: spark.read.parquet(f"{SF}/{t}.parquet"), F.col("c_custkey")
    customer = read("customer").crossJoin(spark.range(100)).withColumn("c_custkey", key + F.col("id") * 1000).drop("id")
    tables = {t: read(t) for t in ("region", "nation", "documents")}
    tables["customer"] = customer.withColumns({"c_mktsegment": F.when(key % 7 > 0, "BUILDING").otherwise("OTHER"), "c_acctbal": F.when(key % 11 > 0, 6000.0).otherwise(5000.0)})
    tables["orders"] = read("orders").withColumn("o_custkey", F.col("o_custkey") + F.col("o_orderkey") % 100 * 1000)
    tables["labels"] = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 12 > 0).cast("int").alias("toxic"))
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{base}/{name}.parquet")
    return base


def check_query(spark, base, name, children):
    """A registered query against its SQL, where so many children match that the old ceiling refused them."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(base):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{base}/{t}/*.parquet'")
    assert con.execute(f"SELECT count(*) FROM {children}").fetchall()[0][0] > 10_000
    wanted = sorted(r[0] for r in con.execute(catalog.ORACLES[name]).fetchall())
    assert wanted and sorted(r["id"] for r in catalog.QUERIES[name](spark, base).collect()) == wanted


def test_the_query_by_id_equals_its_sql(spark, many):
    check_query(spark, many, "j_reference", "customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")


def test_the_query_by_a_field_equals_its_sql(spark, many):
    check_query(spark, many, "j_reference_label", "labels WHERE toxic = 1")


def test_no_registered_search_has_a_ceiling_but_the_one_about_refusals(spark, many, monkeypatch):
    """What queries search with, as they are run: only j_reference_ceiling sets a ceiling, and only on its own searcher."""
    made = []
    plain = catalog.searcher
    monkeypatch.setattr(catalog, "searcher", lambda *a: made.append(plain(*a)) or made[-1])
    for name in ("j_reference", "j_reference_empty", "j_reference_label"):
        catalog.QUERIES[name](spark, many)
    assert [s.ceiling for s in made] == [None] * 3
    catalog.QUERIES["j_reference_ceiling"](spark, many)
    assert [s.ceiling for s in made[3:]] == [290] and catalog.searcher(spark, many).ceiling is None
