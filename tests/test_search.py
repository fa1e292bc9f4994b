from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweave.config import load
from docweave.errors import InvalidArgument, UnknownResource
from docweave.functions import text
from docweave.functions.predicates import Filter, ip_key, operand, read_date
from docweave.operators.federated import FederatedRequest, federated_search
from docweave.operators.search import Searcher, SearchRequest, Sort, page_window
from docweave.plans.denorm import documents
from docweave.plans.schema import document_schema
from docweave.sources.registry import Sources

CONFIG = load(
    """
resources:
  - type: a
    fields: [{name: name, query: {search: primary}}, {name: n, type: long}, {name: at, type: date}, {name: 'on', type: boolean}, {name: tags}, {name: ip, type: ip}, {name: body, type: text}, {name: b_id}]
    relations:
      - {resource: b, join: {local: id, foreign: a_id}, fields: [{name: state, query: {search: secondary}}, {name: size, type: integer}]}
      - {resource: c, strategy: reference, join: {local: b_id, foreign: id}, fields: [{name: name}]}
      - {resource: d, cardinality: one, join: {local: b_id, foreign: id}, fields: [{name: c_id}]}
      - {resource: e, strategy: reference, join: {local: c_id, from: d, foreign: id}, fields: [{name: name}]}
  - type: b
    fields: [{name: state, query: {search: primary}}, {name: size, type: integer}, {name: a_id}]
  - type: c
    fields: [{name: name, query: {search: primary}}]
  - type: d
    fields: [{name: c_id, query: {search: primary}}]
  - type: e
    fields: [{name: name, query: {search: primary}}]
  - type: site
    fields: [{name: name, query: {search: primary}}]
    nestedBlocks: [{name: data, scopeKey: owner, fields: [{name: seen}]}]
"""
)


@pytest.fixture(scope="module")
def search(spark):
    s = Sources(spark)
    rows = [
        ("1", "vx-alpha", 5, dt.datetime(2026, 1, 10), True, ["red", "hot"], "10.0.0.9", "x", "c1"),
        ("2", "vx-beta", 50, dt.datetime(2026, 3, 10), False, [], "10.0.0.10", "x", "c2"),
        ("3", "gamma 7135252-34", 500, dt.datetime(2026, 6, 10), None, None, "::1", None, None),
    ]
    s.add("a", spark.createDataFrame(rows, "id string, name string, n long, at timestamp, `on` boolean, tags array<string>, ip string, body string, b_id string"))
    s.add("b", spark.createDataFrame([("10", "active", 1, "1"), ("11", "inactive", 9, "1"), ("12", "inactive", 1, "2")], "id string, state string, size int, a_id string"))
    s.add("c", spark.createDataFrame([("c1", "acme"), ("c2", "other")], "id string, name string"))
    s.add("d", spark.createDataFrame([("c1", "e1"), ("c2", "e2")], "id string, c_id string"))
    s.add("e", spark.createDataFrame([("e1", "end"), ("e2", "none")], "id string, name string"))
    s.add("site", spark.createDataFrame([("s1", "site one")], "id string, name string"))

    def data(sources, roots):
        return roots.select("id", F.array(F.struct(F.lit("op-A").alias("owner"), F.lit("sp-x").alias("seen")), F.struct(F.lit("op-B").alias("owner"), F.lit("sp-y").alias("seen"))).alias("data"))

    def read(r):
        return documents(CONFIG, s, r, blocks={"data": data} if r == "site" else None)

    return Searcher(CONFIG, read, lambda r: spark.createDataFrame([], document_schema(CONFIG.resource(r).version())).withColumn("id", F.col("resource_id")))


def ids(search, resource="a", **request):
    return {r["id"] for r in search.search(SearchRequest(resource, **request)).hits.collect()}


@pytest.mark.parametrize(
    "filters, expected",
    [
        ([Filter("fields.n", "gte", "50"), Filter("fields.n", "lt", "500")], "2"),
        ([Filter("fields.at", "gt", "2026-03-09")], "23"),
        ([Filter("fields.at", "lte", "2026-01-10||+2M/M")], "1"),
        ([Filter("fields.on", "neq", "true")], "23"),
        ([Filter("fields.on", "not_exists")], "3"),
        ([Filter("fields.tags", "eq", "hot")], "1"),
        ([Filter("fields.tags", "not_in", values=("hot", "cold"))], "23"),
        ([Filter("fields.name", "prefix", "vx-")], "12"),
        ([Filter("fields.name", "contains", "a 7")], "3"),
        ([Filter("fields.ip", "lt", "10.0.0.10")], "13"),
        ([Filter("fields.ip", "eq", "0:0:0:0:0:0:0:1")], "3"),
        ([Filter("b.state", "eq", "active")], "1"),
        ([Filter("b.state", "neq", "active")], "23"),
        ([Filter("b.state", "not_in", values=("active", "inactive"))], "3"),
        ([Filter("b.state", "eq", "active"), Filter("b.size", "gt", "5")], "1"),
        ([Filter("c.name", "eq", "acme")], "1"),
        ([Filter("e.name", "in", values=("end", "x"))], "1"),
        ([Filter("c.name", "eq", "nobody")], ""),
        ([Filter("", "eq", "x")], "123"),
    ],
)
def test_filters(search, filters, expected):
    assert ids(search, filters=tuple(filters)) == set(expected)


@pytest.mark.parametrize(
    "f",
    [
        Filter("fields.body", "eq", "x"), Filter("fields.on", "gt", "true"), Filter("fields.n", "prefix", "1"), Filter("c.name", "neq", "x"), Filter("fields.zzz", "eq", "x"), Filter("data.owner", "eq", "x"),
        Filter("fields.n", "in"), Filter("fields.n", "in", "1", ("1",)), Filter("fields.n", "exists", "1"), Filter("fields.n", "eq"), Filter("fields.n", "eq", "x1"), Filter("fields.on", "eq", "yes"),
        Filter("fields.at", "gt", "yesterday"), Filter("fields.ip", "eq", "300.1.1.1"),
    ],
)
def test_refused_filters(search, f):
    with pytest.raises(InvalidArgument):
        ids(search, filters=(f,))


def test_scoped_blocks(search):
    assert ids(search, "site", scope="op-A", filters=(Filter("data.seen", "eq", "sp-x"),)) == {"s1"}
    assert ids(search, "site", scope="op-A", filters=(Filter("data.seen", "eq", "sp-y"),)) == set()
    assert ids(search, "site", scope="op-A", filters=(Filter("data.seen", "neq", "sp-y"),)) == {"s1"}
    assert ids(search, "site", scope="op-A") == {"s1"}
    assert ids(search, "site", scope="op-C") == ids(search, "site") == set()


def test_reference_ceiling(search):
    limited = Searcher(search.config, search.read, search.empty, ceiling=1)
    with pytest.raises(InvalidArgument):
        ids(limited, filters=(Filter("c.name", "exists"),))
    assert ids(limited, filters=(Filter("c.name", "eq", "acme"),)) == {"1"}  # one child


def test_order_pages_and_totals(search):
    first = search.search(SearchRequest("a", sort=(Sort("fields.on", True), Sort("fields.n")), page_size=2))
    assert [r["id"] for r in first.hits.collect()] == ["1", "2"] and first.total == 3
    up = search.search(SearchRequest("a", sort=(Sort("fields.on"),)))
    assert [r["id"] for r in up.hits.collect()] == ["2", "1", "3"]
    by_ip = search.search(SearchRequest("a", sort=(Sort("fields.ip"),)))
    assert [r["id"] for r in by_ip.hits.collect()] == ["3", "1", "2"]
    assert page_window(0, 0) == (25, 0) and page_window(-1, 1000) == (100, 0) and page_window(99, 100) == (100, 9900)
    with pytest.raises(InvalidArgument):
        page_window(100, 100)
    with pytest.raises(InvalidArgument):
        ids(search, sort=(Sort("fields.body"),))
    with pytest.raises(UnknownResource):
        ids(search, "nothing")


def test_middlewares_come_after_the_check(search):
    def only_first(handler):
        return lambda request: handler(request.with_filter(Filter("fields.n", "lt", "10")))

    assert ids(Searcher(search.config, search.read, search.empty, (only_first,))) == {"1"}


def test_text_search(search):
    assert ids(search, query="7135252") == {"3"}
    assert ids(search, query="alph") == {"1"}
    assert ids(search, query="beta gamma") == {"2", "3"}
    assert ids(search, query="alphx") == set()
    assert ids(search, query="inactive") == set()  # secondary text isn't searched here
    assert ids(search, query="?!") == set() and ids(search, query=" ") == {"1", "2", "3"}


def test_grams_stay_within_words(spark):
    df = spark.createDataFrame([(["Ab-c1 é"],)], "t array<string>")
    row = df.select(text.words(F.col("t")).alias("w"), text.grams(text.words(F.col("t"))).alias("g")).first()
    assert row["w"] == ["ab", "c1", "é"] and row["g"] == ["ab", "c1"]
    assert text.query_grams("Ab-c1 é") == ["ab", "c1"] and text.query_grams("a b") == []


def test_federated(search, spark):
    request = FederatedRequest("inactive", ("a", "b", "c"), page_size=2)
    result = federated_search(search, request)
    assert [tuple(r) for r in result.counts.collect()] == [("a", 2), ("b", 2), ("c", 0)]
    assert result.total == 4 and [r["resource"] for r in result.hits.collect()] == ["b", "b"]  # primary text outranks secondary
    members = [sorted((r["resource"], r["id"]) for r in federated_search(search, FederatedRequest("inactive", ("a", "b", "c"), mode=m)).matches.collect()) for m in ("single-dfs", "single", "fanout")]
    assert members[0] == members[1] == members[2]
    own = federated_search(search, FederatedRequest("", ("a", "site"), resource_filters={"a": (Filter("fields.n", "gt", "10"),)}))
    assert [tuple(r) for r in own.counts.collect()] == [("a", 2), ("site", 0)]
    assert [tuple(r) for r in federated_search(search, FederatedRequest("", ("a", "site"), scope="op-B")).counts.collect()] == [("a", 3), ("site", 1)]
    for bad in (FederatedRequest("x", ()), FederatedRequest("x", ("a",), mode="other"), FederatedRequest("x", ("a", "b"), filters=(Filter("fields.n", "eq", "1"),)), FederatedRequest("x", ("a",), filters=(Filter("b.state", "eq", "x"),))):
        with pytest.raises(InvalidArgument):
            federated_search(search, bad)


def test_dates():
    now = dt.datetime(2026, 3, 31, 12, 30, tzinfo=dt.timezone.utc)
    assert read_date("now-1M/d", now).isoformat() == "2026-02-28T00:00:00+00:00"
    assert read_date("now/w", now).isoformat() == "2026-03-30T00:00:00+00:00"
    assert read_date("2026-03||+1y").isoformat() == "2027-03-01T00:00:00+00:00"
    assert read_date("1767225600000").isoformat() == "2026-01-01T00:00:00+00:00"
    assert read_date("2026-01-01T02:00:00+02:00").isoformat() == "2026-01-01T00:00:00+00:00"
    with pytest.raises(ValueError):
        read_date("now+1x")


def test_addresses(spark):
    rows = ["1.2.3.4", "::ffff:1", "2001:db8::8:800:200c:417a", "zzz", None, "::"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a string")
    found = [r[0] for r in df.orderBy("i").select(ip_key(F.col("a"))).collect()]
    assert found == ["0" * 20 + "ffff01020304", "0" * 24 + "ffff0001", "20010db80000000000080800200c417a", None, None, "0" * 32]


def test_operands_keep_large_numbers():
    from docweave.config import Field

    assert str(2**53 + 1) in str(operand(Field("n", "long"), str(2**53 + 1)))
    with pytest.raises(InvalidArgument):
        operand(Field("n", "integer"), str(2**31))


def test_surfaces_count_like_token_arrays(spark):
    """Words and grams of a surface string against those of token arrays."""
    rows = ["Ab-ab ab", "", "!!", "a", "a b c", "aaa aaaa xaab", "one, two;three\nÉcole 12 1", "  lead and trail  "]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", text.surface(F.array("t")).alias("s"), text.words(F.array("t")).alias("w"))
    df = df.withColumn("g", text.grams(F.col("w")))
    terms, parts = ["ab", "aaa", "a", "one", "école"], ["aa", "ab", "aaa", "bb", "le", "12"]
    row = df.select(
        "w", "g", text.word_total(F.col("s")).alias("nw"), text.gram_total(F.col("s")).alias("ng"),
        F.array(*[text.count_word(F.col("s"), x) for x in terms]).alias("tw"), F.array(*[text.count_gram(F.col("s"), x) for x in parts]).alias("tg"),
    ).collect()
    for r in row:
        assert (r["nw"], r["ng"]) == (len(r["w"]), len(r["g"]))
        assert r["tw"] == [r["w"].count(x) for x in terms] and r["tg"] == [r["g"].count(x) for x in parts]
