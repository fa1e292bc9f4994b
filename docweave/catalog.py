"""The registered queries over the sample tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.config import Config, load
from docweave.functions import text
from docweave.functions.predicates import Filter
from docweave.operators import state as st
from docweave.operators.federated import FederatedRequest, federated_search
from docweave.operators.scan import after
from docweave.operators.search import Searcher, SearchRequest, Sort, sort_order
from docweave.plans import denorm
from docweave.plans.schema import document_schema, schema_diff
from docweave.sources import files
from docweave.sources.registry import Sources, parquet_tables

CONFIG = """
resources:
  - type: region
    fields:
      - {name: name, query: {search: primary}}
  - type: nation
    fields:
      - {name: name, query: {search: primary}}
      - {name: region_id}
  - type: customer
    version: 1
    fields: &customer
      - {name: name, query: {search: primary}}
      - {name: segment, query: {search: secondary}}
      - {name: acctbal, type: double}
      - {name: nation_id}
    relations:
      - resource: region
        cardinality: one
        join: {local: region_id, from: nation, foreign: id}
        fields: [{name: name, query: {search: secondary}}]
      - resource: nation
        cardinality: one
        join: {local: nation_id, foreign: id}
        fields: [{name: name, query: {search: primary}}]
      - resource: order
        join: {local: id, foreign: cust_id}
        fields: [{name: status}, {name: priority, query: {search: secondary}}, {name: total, type: double}]
  - type: customer
    version: 2
    readVersion: 1
    fields: *customer
    relations:
      - resource: order
        cardinality: one
        join: {local: id, foreign: cust_id}
        fields: [{name: status}, {name: total, type: double}, {name: date, type: date}]
  - type: order
    fields:
      - {name: status}
      - {name: priority}
      - {name: total, type: double}
      - {name: date, type: date}
      - {name: cust_id}
    relations:
      - resource: customer
        strategy: reference
        join: {local: cust_id, foreign: id}
        fields: [{name: segment}, {name: acctbal, type: double}]
  - type: shipment
    fields: [{name: status}, {name: total, type: double}]
    relations:
      - resource: line
        join: {local: id, foreign: order_id}
        fields: [{name: quantity, type: double}, {name: flag}, {name: part_id}]
  - type: line
    fields:
      - {name: order_id}
      - {name: part_id}
      - {name: quantity, type: double}
      - {name: flag}
      - {name: ship, type: date}
    relations:
      - resource: order
        cardinality: one
        join: {local: order_id, foreign: id}
        fields: [{name: cust_id}, {name: status}]
      - resource: customer
        strategy: reference
        join: {local: cust_id, from: order, foreign: id}
        fields: [{name: segment}]
  - type: part
    fields:
      - {name: name, query: {search: primary}}
      - {name: brand}
      - {name: type, query: {search: secondary}}
      - {name: size, type: integer}
      - {name: price, type: double}
  - type: supplier
    fields:
      - {name: name, query: {search: primary}}
      - {name: acctbal, type: double}
      - {name: large, type: boolean}
      - {name: address, type: ip}
    nestedBlocks:
      - name: offers
        scopeKey: part_id
        fields: [{name: flag}, {name: quantity, type: double}]
  - type: vendor
    fields:
      - {name: name, query: {search: primary}}
      - {name: acctbal, type: double}
      - {name: large, type: boolean}
      - {name: address, type: ip}
  - type: document
    fields:
      - {name: text, type: text, query: {search: primary}}
      - {name: lang}
      - {name: source}
      - {name: n_chars, type: long}
    relations:
      - resource: label
        strategy: reference
        join: {local: id, foreign: doc_id}
        fields: [{name: toxic, type: integer}, {name: quality, type: integer}]
  - type: label
    fields: [{name: doc_id}, {name: toxic, type: integer}, {name: quality, type: integer}]
  - type: item
    fields: [{name: text, type: text, query: {search: primary}}]
  - type: talk
    fields: [{name: title, query: {search: primary}}]
"""

_LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def config() -> Config:
    return load(CONFIG)


def sources(spark: SparkSession, sf_dir: str) -> Sources:
    t = parquet_tables(spark, sf_dir)
    found = Sources(spark)
    found.add("region", lambda: t("region"), "r_regionkey", {"name": "r_name"})
    found.add("nation", lambda: t("nation"), "n_nationkey", {"name": "n_name", "region_id": F.col("n_regionkey").cast("string")})
    found.add("customer", lambda: t("customer"), "c_custkey", {"name": "c_name", "segment": "c_mktsegment", "acctbal": "c_acctbal", "nation_id": F.col("c_nationkey").cast("string")})
    order = {"status": F.nullif(F.col("o_orderstatus"), F.lit("P")), "priority": "o_orderpriority", "total": "o_totalprice", "date": "o_orderdate", "cust_id": F.col("o_custkey").cast("string")}
    found.add("order", lambda: t("orders"), "o_orderkey", order)
    found.add("shipment", lambda: t("orders"), "o_orderkey", {"status": "o_orderstatus", "total": "o_totalprice"})
    line = {"order_id": F.col("l_orderkey").cast("string"), "part_id": F.col("l_partkey").cast("string"), "quantity": "l_quantity", "flag": "l_returnflag", "ship": "l_shipdate"}
    # lines have no id of their own, and repeat; a digest of the whole row stands for one
    found.add("line", lambda: t("lineitem"), F.concat_ws("|", *[F.col(c).cast("string") for c in _LINE_ID]), line)
    found.add("part", lambda: t("part"), "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"})
    address = F.concat_ws(".", F.lit("10"), (F.col("s_suppkey") % 7).cast("string"), (F.col("s_suppkey") % 251).cast("string"), F.lit("9"))
    for name in ("supplier", "vendor"):
        found.add(name, lambda: t("supplier"), "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "large": F.col("s_acctbal") > 5000, "address": address})
    found.add("document", lambda: t("documents"), "doc_id", {"text": "text", "lang": "lang", "source": "source", "n_chars": "n_chars"})
    found.add("label", lambda: t("labels"), "doc_id", {"doc_id": F.col("doc_id").cast("string"), "toxic": "toxic", "quality": "quality"})
    found.add("item", lambda: t("benchmark"), "item_id", {"text": "text"})
    found.add("talk", lambda: t("conversations").select("conv_id").distinct(), "conv_id", {"title": F.lit("talk")})
    return found


def _offers(found: Sources, roots: DataFrame) -> DataFrame:
    """A supplier's block: one entry for each part and flag that it ships, with the largest quantity."""
    rows = found.listing("__lines").groupBy("id", "part_id", "flag").agg(F.max("quantity").alias("quantity"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part_id", "flag", "quantity"))).alias("offers"))


def _turns(found: Sources, roots: DataFrame) -> DataFrame:
    """A talk's secondary entries: one for each turn, visible to its role."""
    rows = found.listing("__turns")
    entry = F.struct(F.array("text").alias("text"), F.array("role").alias("scope"))
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]).alias("search_secondary"))


def documents(spark: SparkSession, sf_dir: str, resource: str, version: int | None = None) -> DataFrame:
    found, t = sources(spark, sf_dir), parquet_tables(spark, sf_dir)
    found.add("__lines", lambda: t("lineitem"), "l_suppkey", {"part_id": F.col("l_partkey").cast("string"), "flag": "l_returnflag", "quantity": "l_quantity"})
    found.add("__turns", lambda: t("conversations"), "conv_id", {"turn": "turn", "role": "role", "text": "text"})
    blocks = {"offers": _offers} if resource == "supplier" else None
    return denorm.documents(config(), found, resource, version, blocks=blocks, secondary=_turns if resource == "talk" else None).drop("found")


def searcher(spark: SparkSession, sf_dir: str) -> Searcher:
    return Searcher(config(), lambda r: documents(spark, sf_dir, r), lambda r: spark.createDataFrame([], document_schema(config().resource(r).version())))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# filters: (name, resource, filters, SQL over the same rows)

_ORDERS = "(SELECT CAST(o_orderkey AS VARCHAR) AS id, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority, o_totalprice AS total, o_orderdate AS date, o_custkey FROM orders)"
_PARTS = "(SELECT CAST(p_partkey AS VARCHAR) AS id, * FROM part)"
_CUST = "(SELECT CAST(c_custkey AS VARCHAR) AS id, * FROM customer)"
_SUPP = (
    "(SELECT CAST(s_suppkey AS VARCHAR) AS id, *, (10 * 16777216 + (s_suppkey % 7) * 65536 + (s_suppkey % 251) * 256 + 9) AS address FROM supplier)"
)

_FILTERS: list[tuple[str, str, list[Filter], str, str]] = [
    ("f_eq", "order", [Filter("fields.status", "eq", "F")], _ORDERS, "status = 'F'"),
    ("f_neq", "order", [Filter("fields.status", "neq", "F")], _ORDERS, "status IS DISTINCT FROM 'F'"),
    ("f_in", "order", [Filter("fields.priority", "in", values=("1-URGENT", "2-HIGH"))], _ORDERS, "priority IN ('1-URGENT', '2-HIGH')"),
    ("f_not_in", "order", [Filter("fields.status", "not_in", values=("F", "O"))], _ORDERS, "status IS NULL OR status NOT IN ('F', 'O')"),
    ("f_gt", "order", [Filter("fields.total", "gt", "250000.5")], _ORDERS, "total > 250000.5"),
    ("f_gte", "order", [Filter("fields.date", "gte", "1997-06-01")], _ORDERS, "date >= TIMESTAMP '1997-06-01'"),
    ("f_lt", "part", [Filter("fields.size", "lt", "7")], _PARTS, "p_size < 7"),
    ("f_lte", "customer", [Filter("fields.acctbal", "lte", "-100")], _CUST, "c_acctbal <= -100"),
    ("f_range_and", "order", [Filter("fields.date", "gte", "1995-01-01"), Filter("fields.date", "lt", "1995-01-01||+1M/d")], _ORDERS, "date >= TIMESTAMP '1995-01-01' AND date < TIMESTAMP '1995-02-01'"),
    ("f_date_millis", "order", [Filter("fields.date", "lt", "804556800000")], _ORDERS, "date < TIMESTAMP '1995-07-01'"),
    ("f_prefix", "part", [Filter("fields.name", "prefix", "b")], _PARTS, "starts_with(p_name, 'b')"),
    ("f_suffix", "part", [Filter("fields.type", "suffix", "L")], _PARTS, "ends_with(p_type, 'L')"),
    ("f_contains", "part", [Filter("fields.brand", "contains", "#2")], _PARTS, "contains(p_brand, '#2')"),
    ("f_contains_meta", "part", [Filter("fields.brand", "contains", "B%_*")], _PARTS, "contains(p_brand, 'B%_*')"),
    ("f_exists", "order", [Filter("fields.status", "exists")], _ORDERS, "status IS NOT NULL"),
    ("f_not_exists", "order", [Filter("fields.status", "not_exists")], _ORDERS, "status IS NULL"),
    ("f_boolean", "vendor", [Filter("fields.large", "eq", "true"), Filter("fields.acctbal", "lt", "9000")], _SUPP, "s_acctbal > 5000 AND s_acctbal < 9000"),
    ("f_ip_range", "vendor", [Filter("fields.address", "gt", "10.2.200.1"), Filter("fields.address", "lte", "10.5.0.0")], _SUPP, f"address > {(10 << 24) + (2 << 16) + (200 << 8) + 1} AND address <= {(10 << 24) + (5 << 16)}"),
    ("f_ignored", "part", [Filter("", "eq", "x"), Filter("fields.size", "eq", "10")], _PARTS, "p_size = 10"),
    ("f_nested_eq", "customer", [Filter("order.priority", "eq", "1-URGENT")], _CUST, "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    ("f_nested_neq", "customer", [Filter("order.priority", "neq", "1-URGENT")], _CUST, "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    ("f_nested_not_in", "customer", [Filter("order.priority", "not_in", values=("1-URGENT", "5-LOW"))], _CUST, "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '5-LOW'))"),
    (
        "f_nested_two", "customer", [Filter("order.status", "eq", "F"), Filter("order.total", "gt", "450000")], _CUST,
        "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    ("f_nested_empty", "shipment", [Filter("line.flag", "not_exists")], "(SELECT CAST(o_orderkey AS VARCHAR) AS id, * FROM orders)", "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IS NOT NULL)"),
    ("j_reference", "order", [Filter("customer.segment", "eq", "BUILDING"), Filter("customer.acctbal", "gt", "5000")], _ORDERS, "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)"),
    ("j_reference_empty", "order", [Filter("customer.segment", "eq", "NOBODY")], _ORDERS, "false"),
    ("j_reference_label", "document", [Filter("label.toxic", "eq", "1"), Filter("fields.lang", "eq", "en")], "(SELECT CAST(doc_id AS VARCHAR) AS id, * FROM documents)", "lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
]


def _filter_query(resource: str, filters: list[Filter]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return searcher(spark, sf_dir).matches(SearchRequest(resource, filters=tuple(filters))).select("id")

    return run


for _name, _resource, _list, _rows, _where in _FILTERS:
    QUERIES[_name] = _filter_query(_resource, _list)
    ORACLES[_name] = f"SELECT id FROM {_rows} AS r WHERE {_where}"


@query("j_reference_nested", "SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def j_reference_nested(spark, sf_dir):
    hits = searcher(spark, sf_dir).matches(SearchRequest("line", filters=(Filter("customer.segment", "eq", "MACHINERY"),)))
    return hits.agg(F.count(F.lit(1)).alias("n"), F.sum("fields.quantity").alias("quantity"))


def _scoped(scope: str, *filters: Filter):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return searcher(spark, sf_dir).matches(SearchRequest("supplier", scope=scope, filters=filters)).select("id")

    return run


QUERIES["f_scoped"] = _scoped("7", Filter("offers.flag", "eq", "R"), Filter("offers.quantity", "gt", "10"))
ORACLES["f_scoped"] = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS id FROM (SELECT l_suppkey, l_partkey, l_returnflag, max(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE l_partkey = 7 AND l_returnflag = 'R' AND q > 10"
QUERIES["f_scoped_negated"] = _scoped("7", Filter("offers.flag", "neq", "R"))
ORACLES["f_scoped_negated"] = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey = 7 AND l_returnflag <> 'R'"
QUERIES["f_scoped_unnamed"] = _scoped("11")
ORACLES["f_scoped_unnamed"] = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS id FROM lineitem WHERE l_partkey = 11"
QUERIES["f_scoped_closed"] = _scoped("")
ORACLES["f_scoped_closed"] = "SELECT CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE false"


@query(
    "flagship",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS acctbal, n_name AS nation, r_name AS region, "
    "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') "
    "ORDER BY c_acctbal DESC, id LIMIT 25",
)
def flagship(spark, sf_dir):
    """Customers of a segment and balance without an urgent order, by balance, the first page."""
    request = SearchRequest(
        "customer", filters=(Filter("fields.segment", "eq", "BUILDING"), Filter("fields.acctbal", "gte", "1000"), Filter("order.priority", "neq", "1-URGENT")), sort=(Sort("fields.acctbal", True),)
    )
    hits = searcher(spark, sf_dir).search(request).hits
    return hits.select("id", F.col("fields.name").alias("name"), F.col("fields.acctbal").alias("acctbal"), F.col("nation.name").alias("nation"), F.col("region.name").alias("region"), F.size("order").cast("long").alias("orders"))


# denormalisation


@query("d_one", "SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(n_nationkey AS VARCHAR) AS nation_id, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def d_one(spark, sf_dir):
    return documents(spark, sf_dir, "customer").select("id", F.col("nation.id").alias("nation_id"), F.col("nation.name").alias("nation"))


@query(
    "d_many",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, count(l_orderkey) AS lines, coalesce(sum(l_quantity), 0.0) AS quantity, coalesce(string_agg(l_returnflag, '' ORDER BY l_returnflag), '') AS flags "
    "FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
def d_many(spark, sf_dir):
    total = F.aggregate("line", F.lit(0.0), lambda a, x: a + x["quantity"])
    flags = F.array_join(F.sort_array(F.transform("line", lambda x: x["flag"])), "")
    return documents(spark, sf_dir, "shipment").select("id", F.size("line").cast("long").alias("lines"), total.alias("quantity"), flags.alias("flags"))


@query("d_chain", "SELECT CAST(c_custkey AS VARCHAR) AS id, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def d_chain(spark, sf_dir):
    return documents(spark, sf_dir, "customer").select("id", F.col("region.name").alias("region"))


@query(
    "d_first_wins",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, min(CAST(o_orderkey AS VARCHAR)) AS order_id, arg_min(o_totalprice, CAST(o_orderkey AS VARCHAR)) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
def d_first_wins(spark, sf_dir):
    return documents(spark, sf_dir, "customer", 2).select("id", F.col("order.id").alias("order_id"), F.col("order.total").alias("total"))


@query(
    "d_surfaces",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '|' || n_name AS first, "
    "c_mktsegment || '/' || r_name || coalesce((SELECT '/' || string_agg(o_orderpriority, '/' ORDER BY CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_custkey = c_custkey), '') AS second "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def d_surfaces(spark, sf_dir):
    second = F.array_join(F.transform("search_secondary", lambda e: F.array_join(e["text"], "|")), "/")
    return documents(spark, sf_dir, "customer").select("id", F.array_join("search_primary", "|").alias("first"), second.alias("second"))


@query("d_by_ids", "SELECT id, found FROM (VALUES ('1', true), ('2', true), ('none', false)) AS t(id, found)")
def d_by_ids(spark, sf_dir):
    ids = spark.createDataFrame([("1",), ("2",), ("none",), ("2",)], "id string")
    return denorm.documents(config(), sources(spark, sf_dir), "nation", ids=ids).select("id", "found")


# order and pages


def _page(spark, sf_dir, request: SearchRequest, *columns: Column) -> DataFrame:
    found = searcher(spark, sf_dir)
    hits = found.search(request).hits
    order = sort_order(found.version(request.resource), request.sort, hits)
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(*order))).select("pos", "id", *columns)  # a page: 100 rows at most


@query("o_sort_nulls", f"SELECT row_number() OVER (ORDER BY status DESC NULLS LAST, total, id) AS pos, id, status FROM {_ORDERS} AS r WHERE priority = '3-MEDIUM' AND total < 3000 ORDER BY pos LIMIT 100")
def o_sort_nulls(spark, sf_dir):
    request = SearchRequest("order", filters=(Filter("fields.priority", "eq", "3-MEDIUM"), Filter("fields.total", "lt", "3000")), sort=(Sort("fields.status", True), Sort("fields.total")), page_size=1000)
    return _page(spark, sf_dir, request, F.col("fields.status").alias("status"))


@query("o_topk_page", f"SELECT pos - 40 AS pos, id, total FROM (SELECT row_number() OVER (ORDER BY total DESC, id) AS pos, id, total FROM {_ORDERS} AS r) WHERE pos BETWEEN 41 AND 60")
def o_topk_page(spark, sf_dir):
    return _page(spark, sf_dir, SearchRequest("order", sort=(Sort("fields.total", True),), page=2, page_size=20), F.col("fields.total").alias("total"))


@query("o_keyset", f"SELECT id FROM {_ORDERS} AS r WHERE status IS NULL OR status < 'O' OR (status = 'O' AND total > 200000) OR (status = 'O' AND total = 200000 AND id > '5')")
def o_keyset(spark, sf_dir):
    docs = documents(spark, sf_dir, "order")
    keys = [(F.col("fields.status"), True), (F.col("fields.total"), False), (F.col("id"), False)]
    return docs.where(after(keys, ["O", 200000.0, "5"])).select("id")


@query("o_keyset_null", f"SELECT id FROM {_ORDERS} AS r WHERE status IS NULL AND (total < 100000 OR (total = 100000 AND id > '5'))")
def o_keyset_null(spark, sf_dir):
    docs = documents(spark, sf_dir, "order")
    return docs.where(after([(F.col("fields.status"), False), (F.col("fields.total"), True), (F.col("id"), False)], [None, 100000.0, "5"])).select("id")


@query("a_total", f"SELECT count(*) AS total FROM {_ORDERS} AS r WHERE status = 'F'")
def a_total(spark, sf_dir):
    result = searcher(spark, sf_dir).search(SearchRequest("order", filters=(Filter("fields.status", "eq", "F"),), page_size=5))
    return result.matches.agg(F.count(F.lit(1)).alias("total"))


# text

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_GRAMS = "flatten(list_transform({0}, lambda w: list_concat([substr(w, i, 2) for i in range(1, length(w))], [substr(w, i, 3) for i in range(1, length(w) - 1)])))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def _match_sql(w: str, g: str, query_: str) -> str:
    qw, qg = text.query_words(query_), text.query_grams(query_)
    infix = f"list_has_all({g}, {_list(qg)})" if qg else "false"
    return f"(list_has_any({w}, {_list(qw)}) OR list_has_any({g}, {_list(qw)}) OR {infix})"


def _analysed_sql(rows: str) -> str:
    """rows: SELECT resource, id, first (the primary surface as one text) -> with words w and grams g."""
    return f"SELECT *, {_GRAMS.format('w')} AS g FROM (SELECT *, {_WORDS.format('first')} AS w FROM ({rows}))"


def _bm25_sql(tokens: str, terms: list[str], stats: str) -> str:
    parts = []
    for t in terms:
        tf = f"CAST(len(list_filter({tokens}, lambda x: x = '{t}')) AS DOUBLE)"
        df = f"{stats}.df_{tokens}['{t}']"
        norm = f"1.2 * (0.25 + 0.75 * len({tokens}) / greatest({stats}.mean_{tokens}, 1e-9))"
        parts.append(f"CASE WHEN {tf} > 0 THEN ln(1 + ({stats}.n - {df} + 0.5) / ({df} + 0.5)) * {tf} * 2.2 / ({tf} + {norm}) ELSE 0.0 END")
    return "(" + " + ".join(parts or ["0.0"]) + ")"


def _scored_sql(rows: str, query_: str, local: bool, limit: int | None) -> str:
    qw, qg = text.query_words(query_), text.query_grams(query_)
    terms = list(dict.fromkeys(qw + qg))
    df = lambda c: "MAP {" + ", ".join(f"'{t}': sum(CAST(list_contains({c}, '{t}') AS INT))" for t in terms) + "}"
    by = "resource" if local else "1"
    score = f"greatest(9.0 * {_bm25_sql('w', qw, 's')}, 3.0 * {_bm25_sql('g', qw, 's')}) + CASE WHEN list_has_all(g, {_list(qg)}) THEN {_bm25_sql('g', qg, 's')} ELSE 0.0 END"
    sql = (
        f"WITH a AS ({_analysed_sql(rows)}), s AS (SELECT {by} AS k, count(*) AS n, avg(len(w)) AS mean_w, avg(len(g)) AS mean_g, {df('w')} AS df_w, {df('g')} AS df_g FROM a GROUP BY k) "
        f"SELECT resource, id, round(round({score}, 6), 4) AS score FROM a JOIN s ON s.k = {by} WHERE {_match_sql('w', 'g', query_)}"
    )
    return sql + (f" ORDER BY score DESC, resource, id LIMIT {limit}" if limit else "")


_DOCS_SQL = "SELECT 'document' AS resource, CAST(doc_id AS VARCHAR) AS id, text AS first FROM documents"
_PART_SQL = "SELECT 'part' AS resource, CAST(p_partkey AS VARCHAR) AS id, p_name AS first FROM part"
_ITEM_SQL = "SELECT 'item' AS resource, CAST(item_id AS VARCHAR) AS id, text AS first FROM benchmark"
_CUST_SQL = "SELECT 'customer' AS resource, CAST(c_custkey AS VARCHAR) AS id, c_name || ' ' || n_name AS first FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _text_search(resource: str, query_: str, local: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = searcher(spark, sf_dir).matches(SearchRequest(resource, query_))
        return hits.select(F.lit(resource).alias("resource"), "id", F.round("score", 4).alias("score"))

    return run


QUERIES["t_bm25_global"] = _text_search("document", "worthless idiot")
ORACLES["t_bm25_global"] = _scored_sql(_DOCS_SQL, "worthless idiot", False, None)
QUERIES["t_infix"] = _text_search("customer", "tomer#00000001")
ORACLES["t_infix"] = _scored_sql(_CUST_SQL, "tomer#00000001", False, None)
QUERIES["t_word"] = _text_search("part", "red")
ORACLES["t_word"] = _scored_sql(_PART_SQL, "red", False, None)


@query("t_empty", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(0 AS DOUBLE) AS score FROM part WHERE p_size = 3")
def t_empty(spark, sf_dir):
    return searcher(spark, sf_dir).matches(SearchRequest("part", "", filters=(Filter("fields.size", "eq", "3"),))).select("id", "score")


def _federated(spark, sf_dir, query_: str, types: tuple[str, ...], mode: str = "single-dfs", **more):
    return federated_search(searcher(spark, sf_dir), FederatedRequest(query_, types, mode=mode, page_size=100, **more))


_FED = ("part", "item", "document")


def _fed_sql(query_: str, local: bool) -> str:
    return _scored_sql(f"{_PART_SQL} UNION ALL {_ITEM_SQL} UNION ALL {_DOCS_SQL}", query_, local, None)


@query("t_federated_counts", f"WITH m AS ({_fed_sql('that worthless', False)}) SELECT resource, (SELECT count(*) FROM m WHERE m.resource = r.resource) AS n FROM (VALUES ('part'), ('item'), ('document')) AS r(resource)")
def t_federated_counts(spark, sf_dir):
    return _federated(spark, sf_dir, "that worthless", _FED).counts


for _mode, _local in (("single-dfs", False), ("single", True), ("fanout", True)):

    def _run(spark, sf_dir, _mode=_mode):
        return _federated(spark, sf_dir, "moron disgusting", _FED, _mode).matches.select("resource", "id", F.round("score", 4).alias("score"))

    QUERIES[f"t_federated_{_mode.replace('-', '_')}"] = _run
    ORACLES[f"t_federated_{_mode.replace('-', '_')}"] = _scored_sql(
        f"SELECT 'part' AS resource, CAST(p_partkey AS VARCHAR) AS id, p_name AS first FROM part UNION ALL {_ITEM_SQL} UNION ALL {_DOCS_SQL}", "moron disgusting", _local, None
    )


@query("t_federated_filters", f"SELECT 'part' AS resource, count(*) AS n FROM part WHERE p_size = 5 UNION ALL SELECT 'item', count(*) FROM benchmark UNION ALL SELECT 'supplier', 0")
def t_federated_filters(spark, sf_dir):
    """Each type has filters of its own; a scoped type without a scope keeps a count of 0."""
    return _federated(spark, sf_dir, "", ("part", "item", "supplier"), resource_filters={"part": (Filter("fields.size", "eq", "5"),)}).counts


def _fed_hits(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        request = FederatedRequest("moron disgusting", _FED, mode=mode, page=1, page_size=12)
        return federated_search(searcher(spark, sf_dir), request).hits.select("resource", "id", F.round("score", 4).alias("score"))

    return run


def _fed_hits_sql(local: bool) -> str:
    rows = _scored_sql(f"{_PART_SQL} UNION ALL {_ITEM_SQL} UNION ALL {_DOCS_SQL}", "moron disgusting", local, None).replace("round(round(", "round((", 1).replace(", 6), 4) AS score", "), 6) AS score", 1)
    return f"SELECT resource, id, round(score, 4) AS score FROM (SELECT * FROM ({rows}) ORDER BY score DESC, resource || '_search', id LIMIT 12 OFFSET 12)"


for _mode, _local in (("single-dfs", False), ("single", True), ("fanout", True)):
    QUERIES[f"t_federated_hits_{_mode.replace('-', '_')}"] = _fed_hits(_mode)
    ORACLES[f"t_federated_hits_{_mode.replace('-', '_')}"] = _fed_hits_sql(_local)


def _secondary(scope: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _federated(spark, sf_dir, "nicht", ("talk",), secondary_scope=scope).matches.select("id")

    return run


def _secondary_sql(scope: str) -> str:
    rows = "SELECT conv_id AS resource, CAST(conv_id AS VARCHAR) AS id, role, text AS first FROM conversations"
    return f"SELECT DISTINCT id FROM ({_analysed_sql(rows)}) WHERE {_match_sql('w', 'g', 'nicht')}" + (f" AND role = '{scope}'" if scope else "")


QUERIES["t_secondary"], ORACLES["t_secondary"] = _secondary(""), _secondary_sql("")
QUERIES["t_secondary_scope"], ORACLES["t_secondary_scope"] = _secondary("user"), _secondary_sql("user")


def _secondary_scored_sql(query_: str, scope: str = "") -> str:
    """Every talk's score: the mean over its matching turns, with statistics over the turns of a talk taken together."""
    qw, qg = text.query_words(query_), text.query_grams(query_)
    terms = list(dict.fromkeys(qw + qg))
    df = lambda c: "MAP {" + ", ".join(f"'{t}': sum(CAST(list_contains({c}, '{t}') AS INT))" for t in terms) + "}"
    rows = "SELECT CAST(conv_id AS VARCHAR) AS id, role, text AS first FROM conversations"
    score = f"greatest(3.0 * {_bm25_sql('w', qw, 's')}, 1.0 * {_bm25_sql('g', qw, 's')}) + CASE WHEN list_has_all(g, {_list(qg)}) THEN {_bm25_sql('g', qg, 's')} ELSE 0.0 END"
    return (
        f"WITH e AS ({_analysed_sql(rows)}), d AS (SELECT id, flatten(list(w)) AS w, flatten(list(g)) AS g FROM e GROUP BY id), "
        f"s AS (SELECT count(*) AS n, avg(len(w)) AS mean_w, avg(len(g)) AS mean_g, {df('w')} AS df_w, {df('g')} AS df_g FROM d) "
        f"SELECT id, round(round(avg({score}), 6), 4) AS score FROM e, s WHERE {_match_sql('w', 'g', query_)}" + (f" AND role = '{scope}'" if scope else "") + " GROUP BY id"
    )


@query("t_secondary_scores", _secondary_scored_sql("nicht"))
def t_secondary_scores(spark, sf_dir):
    return _federated(spark, sf_dir, "nicht", ("talk",)).matches.select("id", F.round("score", 4).alias("score"))


@query("t_secondary_scope_scores", _secondary_scored_sql("nicht wir", "user"))
def t_secondary_scope_scores(spark, sf_dir):
    return _federated(spark, sf_dir, "nicht wir", ("talk",), secondary_scope="user").matches.select("id", F.round("score", 4).alias("score"))


_REFUSED = (
    ("a range of a keyword", Filter("fields.status", "gt", "F")), ("a part of a number", Filter("fields.total", "prefix", "1")), ("a list for one value", Filter("fields.status", "eq", values=("F",))),
    ("one value for a list", Filter("fields.status", "in", "F")), ("a value of presence", Filter("fields.status", "exists", "F")), ("an unknown field", Filter("fields.none", "eq", "F")),
    ("a negated reference", Filter("customer.segment", "neq", "BUILDING")), ("a word as a number", Filter("fields.total", "gte", "many")), ("nested rows that aren't", Filter("fields.status", "eq", "F", nested_path="fields")),
    ("an unknown operator", Filter("fields.status", "like", "F")), ("a plain filter", Filter("fields.status", "eq", "F")), ("no field", Filter("", "like", "F")),
)


@query("f_refusals", "SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {str(n not in ('a plain filter', 'no field')).lower()})" for n, _ in _REFUSED) + ") AS t(filter, refused)")
def f_refusals(spark, sf_dir):
    """Which filters on orders are refused before anything runs."""
    from docweave.errors import InvalidArgument

    def refused(f: Filter) -> bool:
        try:
            searcher(spark, sf_dir).matches(SearchRequest("order", filters=(f,)))
        except InvalidArgument:
            return True
        return False

    return spark.createDataFrame([(n, refused(f)) for n, f in _REFUSED], "filter string, refused boolean")


@query("j_reference_ceiling", "SELECT c_mktsegment AS segment, count(*) > 290 AS refused FROM customer GROUP BY c_mktsegment")
def j_reference_ceiling(spark, sf_dir):
    """A reference is refused by how many children pass, here by customers of a segment."""
    from docweave.errors import InvalidArgument

    limited = searcher(spark, sf_dir)
    limited.ceiling = 290

    def refused(segment: str) -> bool:
        try:
            limited.matches(SearchRequest("order", filters=(Filter("customer.segment", "eq", segment),)))
        except InvalidArgument:
            return True
        return False

    segments = [r[0] for r in parquet_tables(spark, sf_dir)("customer").select("c_mktsegment").distinct().collect()]  # five
    return spark.createDataFrame([(x, refused(x)) for x in segments], "segment string, refused boolean")


# change propagation

_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'updated' END"
_LOG_SQL = f"SELECT 'customer' AS type, CAST(user_id AS VARCHAR) AS id, {_KIND} AS kind, event_id + 1 AS version, (event_id * 7919) % 1000003 AS ord FROM events"


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as notifications, in an order in which many are late."""
    events = parquet_tables(spark, sf_dir)("events")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return events.select(
        F.lit("customer").alias("type"), F.col("user_id").cast("string").alias("id"), kind.alias("kind"), (F.col("event_id") + 1).alias("version"),
        ((F.col("event_id") * 7919) % 1000003).alias("ord"), F.create_map(F.lit("kind"), "event_type").alias("metadata"), F.unix_timestamp("ts").cast("double").alias("at"),
    )


_GATE_SQL = f"""
WITH log AS ({_LOG_SQL}),
lives AS (SELECT *, coalesce(sum(CAST(kind = 'deleted' AS INT)) OVER (PARTITION BY type, id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM log),
seen AS (SELECT *, coalesce(max(CASE WHEN kind = 'deleted' THEN 0 ELSE version END) OVER (PARTITION BY type, id, life ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lives)
SELECT id, ord, kind = 'deleted' OR version > before AS accepted, CASE WHEN kind = 'deleted' THEN 0 ELSE greatest(before, version) END AS stored FROM seen
"""


@query("c_version_gate", _GATE_SQL)
def c_version_gate(spark, sf_dir):
    return st.gate(notifications(spark, sf_dir)).select("id", "ord", "accepted", "stored")


@query("c_tombstone", f"WITH g AS ({_GATE_SQL}) SELECT id, arg_max(stored, ord) AS version, arg_max(stored, ord) = 0 AS tombstone FROM g GROUP BY id")
def c_tombstone(spark, sf_dir):
    gated = st.gate(notifications(spark, sf_dir))
    return gated.groupBy("id").agg(F.max_by("stored", F.struct(*st.arrival())).alias("version")).withColumn("tombstone", F.col("version") == 0)


def _edges(spark, sf_dir, version: int = 1) -> DataFrame:
    built = documents(spark, sf_dir, "customer", version)
    found = denorm.edges(config(), built, "customer", version)
    return found.select(F.lit("customer").alias("type"), "id", F.lit(version).alias("schema_version"), F.lit(1).cast("long").alias("build_seq"), "children")


@query("c_fanout", "SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (n_regionkey = 1 OR n_nationkey = 3) AND c_custkey <> 5")
def c_fanout(spark, sf_dir):
    changed = spark.createDataFrame([("region", "1"), ("nation", "3"), ("customer", "5")], "type string, id string")
    return st.fan_out(changed, _edges(spark, sf_dir))


@query("c_second_fanout", "SELECT 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_custkey % 3 <> 0")
def c_second_fanout(spark, sf_dir):
    """Parents by the edges after a commit, less those that the commit marked."""
    edges = _edges(spark, sf_dir)
    return st.missed_parents(spark.createDataFrame([("region", "1")], "type string, id string"), edges.where(F.col("id").cast("int") % 3 == 0), edges)


@query(
    "c_edges_union",
    "SELECT ctype, count(*) AS n FROM (SELECT DISTINCT c_custkey, 'nation' AS ctype, c_nationkey AS cid FROM customer UNION ALL SELECT DISTINCT c_custkey, 'region', n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT DISTINCT o_custkey, 'order', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ctype",
)
def c_edges_union(spark, sf_dir):
    both = _edges(spark, sf_dir, 1).unionByName(_edges(spark, sf_dir, 2))
    links = both.select("type", "id", F.explode("children").alias("c")).select("type", "id", F.col("c.type").alias("ctype"), F.col("c.id").alias("cid")).distinct()
    return links.groupBy("ctype").agg(F.count(F.lit(1)).alias("n"))


_STATE_SQL = (
    "SELECT 'order' AS type, CAST(user_id AS VARCHAR) AS id, max(event_id) AS change_seq, min(epoch(date_trunc('second', ts))) AS since, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id"
)


def _state(spark, sf_dir) -> DataFrame:
    """A state table made of the events: users as orders, marked since their first event, failed as often as they had errors."""
    log = notifications(spark, sf_dir)
    rows = log.groupBy("id").agg(F.max(F.col("version") - 1).alias("change_seq"), F.min("at").alias("stale_since"), F.count_if(F.col("kind") == "deleted").cast("int").alias("sweep_attempts"))
    return rows.select(
        F.lit("order").alias("type"), "id", F.lit(0).cast("long").alias("version"), F.lit(0).cast("long").alias("build_idx"), F.col("change_seq").alias("stale_seq"), "change_seq",
        F.when(F.col("id").cast("int") % 3 != 0, F.col("stale_since")).alias("stale_since"), (F.col("id").cast("int") % 11 == 0).alias("tombstone"), F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("long").alias("owner_seq"), F.lit(None).cast("double").alias("owner_since"), "sweep_attempts",
        F.when(F.col("id").cast("int") % 5 == 0, F.col("stale_since") + st.backoff(F.col("sweep_attempts"))).alias("sweep_after"),
    )


@query(
    "c_drift",
    f"WITH s AS ({_STATE_SQL}) SELECT DISTINCT 'customer' AS type, CAST(o_custkey AS VARCHAR) AS id FROM orders JOIN s ON s.id = CAST(o_orderkey AS VARCHAR) JOIN customer ON o_custkey = c_custkey "
    "WHERE change_seq > (SELECT max(event_id) - 200 FROM events)",
)
def c_drift(spark, sf_dir):
    state = _state(spark, sf_dir)
    start = state.agg(F.max("change_seq")).first()[0] - 200
    return st.drifted(_edges(spark, sf_dir), state, start)


@query("c_latest_wins", f"WITH log AS ({_LOG_SQL}) SELECT id, max(version) AS build_seq, arg_max(kind, version) AS kind FROM log GROUP BY id HAVING arg_max(kind, version) <> 'deleted'")
def c_latest_wins(spark, sf_dir):
    from docweave.sources.store import latest

    log = notifications(spark, sf_dir).select("id", F.col("version").alias("build_seq"), "kind", F.col("ord").alias("write_ord"), (F.col("kind") == "deleted").alias("deleted"))
    return latest(log, ("id",), ("build_seq",))


_WAIT = "least(300.0 * pow(2.0, least(greatest(attempts, 1) - 1, 62)), 86400.0)"


@query("c_backoff", f"WITH s AS ({_STATE_SQL}) SELECT id, {_WAIT} AS wait FROM s")
def c_backoff(spark, sf_dir):
    return _state(spark, sf_dir).select("id", st.backoff(F.col("sweep_attempts")).alias("wait"))


@query(
    "c_stale_order",
    f"WITH s AS ({_STATE_SQL}), t AS (SELECT id, since, CASE WHEN CAST(id AS INT) % 5 = 0 THEN since + {_WAIT} END AS due FROM s WHERE CAST(id AS INT) % 3 <> 0) "
    "SELECT id, coalesce(due, since) AS turn FROM t WHERE since <= (SELECT max(since) FROM s) - 60 AND (due IS NULL OR due <= (SELECT max(since) FROM s)) ORDER BY turn, id LIMIT 20",
)
def c_stale_order(spark, sf_dir):
    state = _state(spark, sf_dir)
    now = notifications(spark, sf_dir).groupBy("id").agg(F.min("at").alias("at")).agg(F.max("at")).first()[0]
    return st.stale_order(state, now, 60.0, 20).select("id", F.coalesce("sweep_after", "stale_since").alias("turn"))


@query("c_backlog", f"WITH s AS ({_STATE_SQL}) SELECT type, count(*) AS stale, min(since) AS oldest FROM s WHERE CAST(id AS INT) % 3 <> 0 GROUP BY type")
def c_backlog(spark, sf_dir):
    return st.backlog(_state(spark, sf_dir))


@query(
    "c_coverage",
    f"WITH s AS ({_STATE_SQL}) SELECT count(*) AS live, count(*) FILTER (CAST(id AS INT) % 3 = 0 AND CAST(id AS INT) % 2 = 1) AS uncovered FROM s WHERE CAST(id AS INT) % 11 <> 0",
)
def c_coverage(spark, sf_dir):
    state = _state(spark, sf_dir)
    sets = state.where(F.col("id").cast("int") % 2 == 0).select("type", "id", F.lit(1).alias("schema_version"))
    return st.coverage(state, sets, "order", 1)


@query(
    "c_register",
    f"WITH log AS ({_LOG_SQL}), b AS (SELECT * FROM log WHERE version <= 400 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1), "
    "p AS (SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN b ON b.id = CAST(o_orderkey AS VARCHAR)) "
    "SELECT 'item' AS role, count(*) AS n, count(*) FILTER (kind = 'deleted') AS tombstones FROM b UNION ALL SELECT 'parent', count(*), 0 FROM p",
)
def c_register(spark, sf_dir):
    """Users of the first events register as orders; the customers that hold those are marked."""
    own = Window.partitionBy("id").orderBy(F.desc("version"))
    batch = notifications(spark, sf_dir).where("version <= 400").withColumn("rn", F.row_number().over(own)).where("rn = 1").drop("rn", "at").withColumn("type", F.lit("order"))
    rows = st.register(batch, spark.createDataFrame([], st.STATE), _edges(spark, sf_dir), 0, 1 << 40, 0.0)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("tombstone", F.lit(False))).alias("tombstones"))


@query("c_metadata_groups", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def c_metadata_groups(spark, sf_dir):
    from docweave.operators.repair import by_metadata

    rows = notifications(spark, sf_dir).groupBy("type", "id", F.col("metadata")["kind"].alias("kind")).count().select("type", "id", F.create_map(F.lit("kind"), "kind").alias("metadata"))
    return by_metadata(rows).select(F.get_json_object("metadata_key", "$[0].value").alias("event_type"), "n")


@query(
    "r_reverse_sweep",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 7 = 0",
)
def r_reverse_sweep(spark, sf_dir):
    from docweave.operators.repair import missing

    orders = sources(spark, sf_dir).listing("order").select(F.lit("order").alias("type"), "id")
    return missing(orders, orders.where(F.col("id").cast("long") % 7 != 0)).select("id")


@query("r_reconcile", "SELECT id, outcome FROM (VALUES ('a', 'doc'), ('b', 'nil'), ('c', 'err')) AS t(id, outcome)")
def r_reconcile(spark, sf_dir):
    from docweave.operators.repair import reconcile

    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    return reconcile(asked, spark.createDataFrame([("a", "doc"), ("b", "nil")], "id string, outcome string"))


@query("s_stream_gate", _GATE_SQL)
def s_stream_gate(spark, sf_dir):
    """The version gate over a stream that is read to its end in one micro-batch."""
    import uuid

    from docweave.streaming.driver import gate_stream

    base = f"{files.shared_base(spark)}/gate-{uuid.uuid4().hex}"
    notifications(spark, sf_dir).select("type", "id", "ord", "kind", "version").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("type string, id string, ord long, kind string, version long").parquet(f"{base}/in")
    run = gate_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "ord", "accepted", "stored")


# migration and capabilities


def _values_sql(columns: str, rows: list[tuple]) -> str:
    def literal(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


@query(
    "m_capabilities",
    "SELECT * FROM (VALUES ('fields.name', 'keyword', true, true, 'eq,neq,in,not_in,prefix,suffix,contains,exists,not_exists'), ('fields.acctbal', 'double', false, true, 'eq,neq,in,not_in,gt,gte,lt,lte,exists,not_exists'), "
    "('fields.large', 'boolean', false, true, 'eq,neq,exists,not_exists'), ('fields.address', 'ip', false, true, 'eq,neq,in,not_in,gt,gte,lt,lte,exists,not_exists'), "
    "('offers.flag', 'keyword', false, true, 'eq,neq,in,not_in,prefix,suffix,contains,exists,not_exists'), ('offers.quantity', 'double', false, true, 'eq,neq,in,not_in,gt,gte,lt,lte,exists,not_exists')) "
    "AS t(field, type, searchable, sortable, filter_ops)",
)
def m_capabilities(spark, sf_dir):
    from docweave.plans.capabilities import capabilities

    return capabilities(spark, config()).where("resource = 'supplier'").select("field", "type", "searchable", "sortable", "filter_ops")


@query(
    "m_schema_diff",
    "SELECT * FROM (VALUES ('nation', 'removed', NULL, 'object'), ('nation.id', 'removed', NULL, 'string'), ('nation.name', 'removed', NULL, 'keyword'), ('region', 'removed', NULL, 'object'), ('region.id', 'removed', NULL, 'string'), "
    "('region.name', 'removed', NULL, 'keyword'), ('order', 'changed', 'object', 'nested'), ('order.priority', 'removed', NULL, 'keyword'), ('order.date', 'added', 'date', NULL)) AS t(path, change, wanted, live)",
)
def m_schema_diff(spark, sf_dir):
    customer = config().resource("customer")
    return schema_diff(spark, document_schema(customer.version(2)), document_schema(customer.version(1)))


# sources, state folds and stores


@query("s_listing_page", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE CAST(p_partkey AS VARCHAR) > '15' ORDER BY id LIMIT 30")
def s_listing_page(spark, sf_dir):
    return sources(spark, sf_dir).after("part", "15", 30).select("id", "name")


@query("s_related", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey IN (3, 7)")
def s_related(spark, sf_dir):
    return sources(spark, sf_dir).related("order", "cust_id", spark.createDataFrame([("3",), ("7",)], "key string")).select("id")


@query("p_parents", "SELECT DISTINCT 'customer' AS type, CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 50 = 1")
def p_parents(spark, sf_dir):
    """Customers that some orders name themselves."""
    found = sources(spark, sf_dir)
    ids = found.listing("order").where(F.col("id").cast("long") % 50 == 1).select("id")
    return denorm.parents_of(config(), found, "order", ids)


@query(
    "c_neighbours",
    "SELECT 'parent' AS side, 'customer' AS type, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'child', 'order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey = 4 "
    "UNION ALL SELECT 'child', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey = 4 UNION ALL SELECT 'child', 'region', CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 4",
)
def c_neighbours(spark, sf_dir):
    found = _edges(spark, sf_dir)
    parents, children = st.neighbours(found, "nation", "3")[0], st.neighbours(found, "customer", "4")[1]
    return parents.select(F.lit("parent").alias("side"), "type", "id").unionByName(children.select(F.lit("child").alias("side"), "type", "id"))


@query("c_live_rows", f"WITH s AS ({_STATE_SQL}) SELECT id FROM s WHERE CAST(id AS INT) % 11 <> 0 AND id > '2' ORDER BY id LIMIT 15")
def c_live_rows(spark, sf_dir):
    return st.live_rows(_state(spark, sf_dir), "order", "2", 15).select("id")


@query("c_uncovered", f"WITH s AS ({_STATE_SQL}) SELECT id FROM s WHERE CAST(id AS INT) % 11 <> 0 AND CAST(id AS INT) % 3 = 0 AND CAST(id AS INT) % 2 = 1")
def c_uncovered(spark, sf_dir):
    state = _state(spark, sf_dir)
    sets = state.where(F.col("id").cast("int") % 2 == 0).select("type", "id", F.lit(1).alias("schema_version"))
    return st.uncovered(state, sets, "order", 1).select("id")


@query("c_last_sequence", f"WITH s AS ({_STATE_SQL}) SELECT max(change_seq) + 5 AS seq FROM s")
def c_last_sequence(spark, sf_dir):
    state = _state(spark, sf_dir)
    sets = state.agg((F.max("change_seq") + 5).alias("build_seq"))
    return st.last_sequence(state, sets)


@query("c_mark", f"WITH s AS ({_STATE_SQL}) SELECT id, CAST(9000000 AS BIGINT) AS stale_seq, CASE WHEN CAST(id AS INT) % 3 <> 0 THEN since ELSE 7.0 END AS stale_since, change_seq FROM s WHERE CAST(id AS INT) < 40")
def c_mark(spark, sf_dir):
    """A fresh mark keeps the oldest stale time and all else."""
    state = _state(spark, sf_dir)
    return st.mark(state.where(F.col("id").cast("int") < 40).select("type", "id"), state, 9_000_000, 7.0).select("id", "stale_seq", "stale_since", "change_seq")


@query("c_claim", f"WITH s AS ({_STATE_SQL}) SELECT id, change_seq AS owner_seq, 50.0 AS owner_since FROM s WHERE CAST(id AS INT) % 4 <> 1")
def c_claim(spark, sf_dir):
    """Rows whose owner's lease runs can't be claimed."""
    owned = F.when(F.col("id").cast("int") % 4 == 1, F.lit(30.0)).when(F.col("id").cast("int") % 4 == 2, F.lit(10.0))
    return st.claim(_state(spark, sf_dir).withColumn("owner_since", owned), 50.0).select("id", "owner_seq", "owner_since")


@query(
    "c_release",
    f"WITH s AS ({_STATE_SQL}) SELECT id, CAST(CASE WHEN CAST(id AS INT) % 2 = 0 THEN attempts + 1 ELSE attempts END AS INT) AS attempts, "
    "CASE WHEN CAST(id AS INT) % 2 = 0 THEN 100.0 + least(300.0 * pow(2.0, least(greatest(attempts + 1, 1) - 1, 62)), 86400.0) ELSE "
    f"CASE WHEN CAST(id AS INT) % 5 = 0 THEN since + {_WAIT} END END AS due FROM s",
)
def c_release(spark, sf_dir):
    """A failed build waits longer, but not one whose row changed since it was claimed."""
    state = _state(spark, sf_dir)
    token = F.when(F.col("id").cast("int") % 2 == 0, F.col("change_seq")).otherwise(F.col("change_seq") - 1)
    state = state.withColumn("owner_seq", token)
    tokens = state.select("type", "id", F.col("owner_seq").alias("token"))
    return st.release(state, tokens, 100.0, failed=True).select("id", F.col("sweep_attempts").alias("attempts"), F.col("sweep_after").alias("due"))


@query(
    "c_finish",
    f"WITH s AS ({_STATE_SQL}) SELECT id, CASE WHEN CAST(id AS INT) % 2 = 0 THEN NULL ELSE change_seq END AS stale_seq, CASE WHEN CAST(id AS INT) % 2 = 0 OR CAST(id AS INT) % 3 = 0 THEN NULL ELSE since END AS stale_since, CAST(77 AS BIGINT) AS build_idx FROM s",
)
def c_finish(spark, sf_dir):
    """A mark that moved on during the build stays for one more; a settled one is cleared."""
    state = _state(spark, sf_dir)
    seen = F.when(F.col("id").cast("int") % 2 == 0, F.col("stale_seq")).otherwise(F.col("stale_seq") - 1)
    return st.finish(state, state.select("type", "id", seen.alias("seen"), F.lit(77).cast("long").alias("build_idx"))).select("id", "stale_seq", "stale_since", "build_idx")


@query(
    "c_begin_delete",
    f"WITH s AS ({_STATE_SQL}) SELECT id, CAST(id AS INT) % 11 <> 0 AS superseded, CAST(CASE WHEN CAST(id AS INT) % 11 = 0 THEN 5001 + CAST(id AS INT) ELSE 0 END AS BIGINT) AS build_idx, "
    "CASE WHEN CAST(id AS INT) % 11 = 0 AND CAST(id AS INT) % 2 = 0 THEN 99.0 ELSE 1.0 END AS owner_since FROM s",
)
def c_begin_delete(spark, sf_dir):
    """Only what is still a tombstone is begun; a token that owns its row renews the lease."""
    state = _state(spark, sf_dir).withColumn("owner_seq", F.col("change_seq")).withColumn("owner_since", F.lit(1.0))
    token = F.when(F.col("id").cast("int") % 2 == 0, F.col("owner_seq")).otherwise(F.lit(-1).cast("long"))
    asked = state.select("type", "id", token.alias("token"), F.col("id").cast("long").alias("nth"))
    return st.begin_delete(state, asked, 5000, 99.0).select("id", "superseded", "build_idx", "owner_since")


@query(
    "c_guarded_delete",
    f"WITH s AS ({_STATE_SQL}) SELECT id, CAST(id AS INT) % 2 = 0 AS removed, CAST(id AS INT) % 2 = 1 AND CAST(id AS INT) % 3 = 0 AS follow_up, "
    "CASE WHEN CAST(id AS INT) % 2 = 1 AND CAST(id AS INT) % 3 = 0 THEN change_seq ELSE 7 END AS owner_seq, CAST(CASE WHEN CAST(id AS INT) % 2 = 1 THEN 0 ELSE attempts END AS INT) AS attempts FROM s",
)
def c_guarded_delete(spark, sf_dir):
    """Rows marked again since they were seen stay; their owner, if it is the caller, owns the follow-up."""
    state = _state(spark, sf_dir).withColumn("owner_seq", F.lit(7).cast("long")).withColumn("owner_since", F.lit(1.0))
    seen = F.when(F.col("id").cast("int") % 2 == 0, F.col("stale_seq")).otherwise(F.col("stale_seq") - 1)
    token = F.when(F.col("id").cast("int") % 3 == 0, 7).otherwise(8).cast("long")
    found = st.guarded_delete(state, state.select("type", "id", seen.alias("seen"), token.alias("token")), 99.0)
    return found.select("id", "removed", "follow_up", "owner_seq", F.col("sweep_attempts").alias("attempts"))


_WALK = "SELECT event_id // 3 AS id, CASE WHEN event_type IN ('signup', 'click') THEN 1 ELSE 2 END AS version, CASE WHEN value > 50 THEN 'doc' ELSE 'nil' END AS outcome FROM events"


@query(
    "r_walk_outcomes",
    f"WITH a AS ({_WALK}), v AS (SELECT id, version, count(DISTINCT outcome) AS n, max(CAST(outcome = 'doc' AS INT)) AS doc FROM a GROUP BY id, version) "
    "SELECT id, CASE WHEN max(n) > 1 THEN 'contradicts' WHEN min(version) > 1 THEN 'partial' WHEN count(*) < 2 THEN 'incomplete' WHEN max(doc) = 1 THEN 'built' ELSE 'left' END AS outcome FROM v GROUP BY id",
)
def r_walk_outcomes(spark, sf_dir):
    """What a walk over two versions' listings settles, events standing for their answers."""
    from docweave.operators.repair import walk_outcomes

    events = parquet_tables(spark, sf_dir)("events")
    version = F.when(F.col("event_type").isin("signup", "click"), 1).otherwise(2)
    answers = events.select(F.expr("event_id div 3").alias("id"), version.alias("version"), F.when(F.col("value") > 50, "doc").otherwise("nil").alias("outcome"))
    return walk_outcomes(answers, [1, 2], False)


@query("r_first_report", "SELECT event_id // 3 AS id, arg_min(event_type, event_id % 3) FILTER (event_type <> 'error') AS kind FROM events GROUP BY 1")
def r_first_report(spark, sf_dir):
    from docweave.operators.repair import first_reports

    told = F.when(F.col("event_type") == "error", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("kind"), F.col("event_type")))
    answers = parquet_tables(spark, sf_dir)("events").select(F.expr("event_id div 3").alias("id"), (F.col("event_id") % 3).alias("version"), told.alias("metadata"))
    return first_reports(answers).select("id", F.col("metadata")["kind"].alias("kind"))


@query("r_merge_versions", "SELECT * FROM (VALUES ('a', 1, 0, 'late'), ('b', 0, 1, 'unanswered'), ('c', 2, 0, NULL)) AS t(id, docs, nils, first_error)")
def r_merge_versions(spark, sf_dir):
    from docweave.operators.repair import merge_versions

    rows = [("a", 1, "doc", None), ("a", 2, "err", "late"), ("b", 1, "nil", None), ("b", 2, "err", None), ("c", 1, "doc", None), ("c", 2, "doc", None)]
    return merge_versions(spark.createDataFrame(rows, "id string, version int, outcome string, error string"))


@query("m_mapping", _values_sql("path, type", [("resource_id", "string"), ("fields", "object"), ("fields.status", "keyword"), ("fields.total", "double"), ("line", "nested"), ("line.id", "string"), ("line.quantity", "double"), ("line.flag", "keyword"), ("line.part_id", "keyword"), ("search_primary", "array<string>"), ("search_secondary", "nested"), ("search_secondary.text", "array<string>"), ("search_secondary.scope", "array<string>")]))
def m_mapping(spark, sf_dir):
    from docweave.plans.schema import paths

    return spark.createDataFrame(paths(document_schema(config().resource("shipment").version())), "path string, type string")


@query("m_alias_moves", _values_sql("targets, move", [("", "create"), ("a_search_v2", "in-sync"), ("a_search_v1", "forward"), ("a_search_v3", "backward"), ("b_search_v1", "foreign"), ("a_search_v1,a_search_v2", "foreign")]))
def m_alias_moves(spark, sf_dir):
    from docweave.operators.migrate import classify_move

    cases = ["", "a_search_v2", "a_search_v1", "a_search_v3", "b_search_v1", "a_search_v1,a_search_v2"]
    return spark.createDataFrame([(t, classify_move("a", [x for x in t.split(",") if x], 2)) for t in cases], "targets string, move string")


def _engine(spark: SparkSession, sf_dir: str, types: tuple[str, ...], keep: dict | None = None):
    """An engine in a folder of its own, with all rows of some types registered and built."""
    import uuid

    from docweave.operators.engine import Engine

    engine = Engine(spark, config(), sources(spark, sf_dir), f"{files.shared_base(spark)}/engine-{uuid.uuid4().hex}", keep=keep or {}, clock=lambda: 0.0)
    for t in types:
        rows = engine.sources.listing(t)
        engine.register(rows.select(F.lit("created").alias("kind"), F.lit(t).alias("type"), "id", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(1).cast("long").alias("version")))
    engine.build()
    engine.point_aliases()
    return engine


@query("e_build_and_search", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
def e_build_and_search(spark, sf_dir):
    """Notifications, a build, an alias, a search: the documents come from the store."""
    engine = _engine(spark, sf_dir, ("nation",))
    return engine.searcher().matches(SearchRequest("nation", filters=(Filter("fields.region_id", "eq", "2"),))).select("id", F.col("fields.name").alias("name"))


@query("e_scan", "SELECT row_number() OVER (ORDER BY p_size DESC, p_brand, CAST(p_partkey AS VARCHAR)) AS pos, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_size > 40")
def e_scan(spark, sf_dir):
    """A scan's pages, one after the other, are the whole order."""
    from docweave.operators.scan import Scanner

    engine = _engine(spark, sf_dir, ("part",))
    scanner = Scanner(engine.searcher(), engine.store, clock=lambda: 0.0)
    request = SearchRequest("part", filters=(Filter("fields.size", "gt", "40"),), sort=(Sort("fields.size", True), Sort("fields.brand")), page_size=max(200, parquet_tables(spark, sf_dir)("part").count() // 8))
    ids, token, pos, kind, out = [], "", 0, "pos long, id string", f"{engine.root}/scanned"
    while True:
        page = scanner.page(SearchRequest(**{**request.__dict__, "page_token": token}))
        ids += [r["id"] for r in page.hits.collect()]  # what a client does: page by page
        token = page.next_token
        if not token or len(ids) >= 100_000:  # it keeps no more of them in memory
            spark.createDataFrame([(pos + i + 1, x) for i, x in enumerate(ids)], kind).write.mode("append").parquet(out)
            pos, ids = pos + len(ids), []
        if not token:
            return spark.read.schema(kind).parquet(out)


@query("e_readiness", _values_sql("gate, ok", [("alias-state", True), ("target-index", True), ("coverage", True), ("doc-gap", True), ("stale-backlog", True)]))
def e_readiness(spark, sf_dir):
    from docweave.operators.migrate import cutover_readiness

    return cutover_readiness(_engine(spark, sf_dir, ("region",)), "region", 1).select("gate", "ok")


@query("e_reverse_sweep", "SELECT 'region' AS type, CAST(r_regionkey AS VARCHAR) AS id FROM region WHERE r_regionkey >= 3")
def e_reverse_sweep(spark, sf_dir):
    """Rows that the source stops returning are marked."""
    from docweave.operators.repair import reverse_sweep

    engine = _engine(spark, sf_dir, ("region",))
    all_rows = engine.sources.listing("region")
    engine.sources.add("region", all_rows.where(F.col("id").cast("int") < 3))
    reverse_sweep(engine, "region")
    return engine.state().where(F.col("stale_seq").isNotNull()).select("type", "id")


@query("r_probe_pass", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey < 4 THEN 'excluded' WHEN n_nationkey < 10 THEN 'marked' ELSE 'kept' END AS outcome FROM nation")
def r_probe_pass(spark, sf_dir):
    """Rows without an edge set: those that the source doesn't return lose their document, the others are marked."""
    from docweave.operators.repair import probe_pass

    engine = _engine(spark, sf_dir, ("nation",))
    number, rows = F.col("id").cast("int"), engine.sources.listing("nation")
    engine.edge_log.append(engine.edge_sets().where((F.col("type") == "nation") & (number < 10)).withColumn("deleted", F.lit(True)))
    engine.sources.add("nation", rows.where(number >= 4))
    probe_pass(engine, "nation", 1)
    docs = engine.store.documents("nation", 1).select("id", F.lit(True).alias("there"))
    found = engine.state().where("type = 'nation'").join(docs, "id", "left")
    return found.select("id", F.when(F.col("stale_seq").isNotNull(), "marked").when(F.col("there"), "kept").otherwise("excluded").alias("outcome"))


def _gapped(spark: SparkSession, sf_dir: str):
    """An engine with customers built in both versions, the second of which lacks every tenth of them."""
    return _engine(spark, sf_dir, ("customer",), {("customer", 2): lambda docs: F.col("id").cast("int") % 10 != 0})


@query("m_doc_gap", "SELECT count(*) FILTER (c_custkey % 10 <> 0) - count(*) AS gap FROM customer")
def m_doc_gap(spark, sf_dir):
    from docweave.operators.migrate import doc_gap

    return spark.createDataFrame([(doc_gap(_gapped(spark, sf_dir), "customer", 2),)], "gap long")


@query(
    "e_readiness_refused",
    "SELECT gate, ok, detail FROM (SELECT 'alias-state' AS gate, true AS ok, 'forward' AS detail UNION ALL SELECT 'target-index', true, 'customer_search_v2' UNION ALL SELECT 'coverage', true, '0 of ' || count(*) || ' rows uncovered' FROM customer "
    "UNION ALL SELECT 'doc-gap', count(*) FILTER (c_custkey % 10 = 0) = 0, '-' || count(*) FILTER (c_custkey % 10 = 0) || ' documents' FROM customer "
    "UNION ALL SELECT 'stale-backlog', count(*) = 0, count(*) || ' rows wait' FROM customer WHERE c_nationkey = 3)",
)
def e_readiness_refused(spark, sf_dir):
    """A version that lacks documents while rows wait for a build isn't ready."""
    from docweave.operators.migrate import cutover_readiness

    engine = _gapped(spark, sf_dir)
    engine.mark(engine.sources.listing("customer").where("nation_id = '3'").select(F.lit("customer").alias("type"), "id"))
    return cutover_readiness(engine, "customer", 2)


@query(
    "e_targeted_rebuild",
    "SELECT 'v1 after' AS what, count(*) FILTER (c_custkey % 50 <> 0) AS n FROM customer UNION ALL SELECT 'v2 after', count(*) FROM customer UNION ALL SELECT 'marked', count(*) FILTER (c_custkey % 50 = 0) FROM customer "
    "UNION ALL SELECT 'v2 settled', count(*) FILTER (c_custkey % 50 <> 0) FROM customer UNION ALL SELECT 'rows settled', count(*) FILTER (c_custkey % 50 <> 0) FROM customer",
)
def e_targeted_rebuild(spark, sf_dir):
    """A rebuild of one version deletes its documents of what is gone and leaves the rows to a build that asks all versions."""
    from docweave.operators.repair import rebuild

    engine = _engine(spark, sf_dir, ("customer",))
    rows = engine.sources.listing("customer")
    engine.sources.add("customer", rows.where(F.col("id").cast("int") % 50 != 0))
    rebuild(engine, "customer", rows.where(F.col("id").cast("int") % 25 == 0).select("id"), [1])
    marked = lambda: engine.state().where("type = 'customer' and stale_seq is not null").count()
    counts = [("v1 after", engine.store.count("customer", 1)), ("v2 after", engine.store.count("customer", 2)), ("marked", marked())]
    engine.run_until_settled()
    counts += [("v2 settled", engine.store.count("customer", 2)), ("rows settled", engine.state().where("type = 'customer'").count())]
    return spark.createDataFrame(counts, "what string, n long")
