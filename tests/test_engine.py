from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.config import load
from docweave.errors import CursorExpired, InvalidArgument, InvalidPageToken, RegistrationAborted, ScanFault, StaleVersion, UnknownResource
from docweave.functions.predicates import Filter
from docweave.operators import migrate, repair
from docweave.operators import state as st
from docweave.operators.engine import Engine
from docweave.operators.scan import Scanner, fingerprint
from docweave.operators.search import SearchRequest, Sort
from docweave.sources.registry import Sources
from docweave.sources.store import Log, parse_index

CONFIG = """
resources:
  - type: a
    fields: [{name: name, query: {search: primary}}]
    relations: [{resource: b, join: {local: id, foreign: a_id}, fields: [{name: state, query: {search: primary}}]}]
  - type: a
    version: 2
    fields: [{name: name, query: {search: primary}}, {name: n, type: long}]
    relations: [{resource: b, join: {local: id, foreign: a_id}, fields: [{name: state}]}]
  - type: b
    fields: [{name: state, query: {search: primary}}, {name: a_id}]
"""


class Tables:
    """Source tables that a test changes."""

    def __init__(self, spark):
        self.spark = spark
        self.a = {"1": ("one", 1), "2": ("two", 2)}
        self.b = {"10": ("active", "1"), "11": ("inactive", "1"), "12": ("inactive", "2")}

    def sources(self) -> Sources:
        s = Sources(self.spark)
        s.add("a", lambda: self.spark.createDataFrame([(k, *v) for k, v in self.a.items()], "id string, name string, n long"))
        s.add("b", lambda: self.spark.createDataFrame([(k, *v) for k, v in self.b.items()], "id string, state string, a_id string"))
        return s


@pytest.fixture()
def world(spark, tmp_path):
    tables = Tables(spark)
    clock = [1000.0]
    engine = Engine(spark, load(CONFIG), tables.sources(), f"file://{tmp_path}/root", clock=lambda: clock[0])
    engine.tables, engine.now = tables, clock
    return engine


def batch(engine, *items):
    rows = [(kind, t, i, {}, v, n) for n, (kind, t, i, v) in enumerate(items)]
    return engine.spark.createDataFrame(rows, st.NOTIFICATION)


def fill(engine):
    engine.register(batch(engine, *[("created", "a", i, 1) for i in engine.tables.a], *[("created", "b", i, 1) for i in engine.tables.b]))
    engine.run_until_settled()
    engine.point_aliases()


def found(engine, *filters, resource="a"):
    return {r["id"] for r in engine.searcher().search(SearchRequest(resource, filters=filters)).hits.collect()}


def test_changes_reach_the_documents_that_hold_them(world):
    fill(world)
    assert found(world, Filter("b.state", "eq", "active")) == {"1"}
    world.tables.b["12"] = ("active", "2")
    world.notify("updated", "b", "12", 2)
    stale = {(r["type"], r["id"]) for r in world.state().where("stale_seq is not null").collect()}
    assert stale == {("b", "12"), ("a", "2")}
    world.run_until_settled()
    assert found(world, Filter("b.state", "eq", "active")) == {"1", "2"}
    with pytest.raises(StaleVersion):
        world.notify("updated", "b", "12", 2)
    world.notify("updated", "b", "12")  # without a version: always accepted
    assert world.state().where("type = 'b' and id = '12'").first()["version"] == 2


def test_a_new_child_marks_its_parent(world):
    fill(world)
    world.tables.b["13"] = ("new", "1")
    world.notify("created", "b", "13", 1)
    world.run_until_settled()
    assert found(world, Filter("b.state", "eq", "new")) == {"1"}


def test_deletes_and_what_the_source_no_longer_has(world):
    fill(world)
    del world.tables.a["1"]
    world.notify("deleted", "a", "1")
    world.run_until_settled()
    assert found(world) == {"2"} and world.state().where("type = 'a' and id = '1'").isEmpty()
    del world.tables.a["2"]
    assert repair.reverse_sweep(world, "a")[0] == repair.ReverseCounts(1, 1)
    world.run_until_settled()
    assert found(world) == set()
    assert world.store.documents("a", 2).count() == 0


def test_batches_are_whole(world):
    with pytest.raises(UnknownResource):
        world.register(batch(world, ("created", "a", "1", 1), ("created", "zzz", "1", 1)))
    with pytest.raises(RegistrationAborted):
        world.register(batch(world, ("created", "a", "1", 1), ("created", "a", "1", 2)))
    assert world.state().isEmpty() and world.register(batch(world)).isEmpty()


def test_each_version_decides_its_documents(world):
    world.keep[("a", 2)] = lambda docs: F.col("fields.n") > 1
    fill(world)
    assert {r["id"] for r in world.store.documents("a", 1).collect()} == {"1", "2"}
    assert {r["id"] for r in world.store.documents("a", 2).collect()} == {"2"}
    sets = {(r["id"], r["schema_version"]): len(r["children"]) for r in world.edge_sets().where("type = 'a'").collect()}
    assert sets == {("1", 1): 2, ("1", 2): 0, ("2", 1): 1, ("2", 2): 1}
    assert world.state().where("type = 'a'").count() == 2


def test_an_older_build_never_shows(world):
    fill(world)
    docs = world.store.documents("a", 1)
    old = docs.withColumn("fields", F.struct(F.lit("old").alias("name")))
    world.store.upsert("a", 1, old, 1)
    assert {r["fields"]["name"] for r in world.store.documents("a", 1).collect()} == {"one", "two"}
    world.store.delete("a", 1, docs.select("id"), 1)
    assert world.store.count("a", 1) == 2
    with pytest.raises(InvalidArgument):
        world.store.upsert("a", 1, docs, 0)
    before = {tuple(r) for r in world.store.documents("a", 1).select("id", "fields.name").collect()}
    world.store.log("a", 1).compact()
    assert {tuple(r) for r in world.store.documents("a", 1).select("id", "fields.name").collect()} == before


def test_sweeps_wait_their_turn(world):
    world.register(batch(world, ("created", "a", "1", 1)))
    assert repair.sweep(world, threshold=60) == 0
    world.now[0] += 100
    assert repair.sweep(world, threshold=60) == 1
    assert world.state().where("stale_seq is not null").isEmpty()
    world.notify("updated", "a", "1", 2)
    world.now[0] += 100
    broken = world.sources
    world.sources = Sources(world.spark)
    with pytest.raises(UnknownResource):
        repair.sweep(world, threshold=60)
    world.sources = broken
    row = world.state().where("id = '1'").first()
    assert row["sweep_attempts"] == 1 and row["sweep_after"] == pytest.approx(world.now[0] + 300) and row["owner_seq"] is None
    assert repair.sweep(world, threshold=60) == 0
    world.now[0] += 301
    assert repair.sweep(world, threshold=60) == 1


def test_probe_pass_and_walks(world):
    fill(world)
    world.config = load(CONFIG + "  - type: c\n    fields: [{name: x, query: {search: primary}}]\n")
    world.edge_log.append(world.edge_sets().where("type = 'a' and schema_version = 2").withColumn("deleted", F.lit(True)))
    del world.tables.a["2"]
    counts = repair.probe_pass(world, "a", 2)
    assert (counts.asked, counts.excluded, counts.marked) == (2, 1, 1)
    world.run_until_settled()
    assert {r["id"] for r in world.store.documents("a", 2).collect()} == {"1"}
    world.tables.a["3"] = ("three", 3)
    assert list(repair.forward_walk(world, "a", page=1)) == ["1", "3"]
    assert "3" in found(world)
    repair.rebuild(world, "a", versions=[2])
    with pytest.raises(InvalidArgument):
        repair.rebuild(world, "a", versions=[9])


def test_scans(world):
    world.tables.a = {f"{i:03d}": (f"n{i % 7}", None if i % 5 == 0 else i % 4) for i in range(40)}
    fill(world)
    world.store.point("a", "a_search_v2")
    world.config = load(CONFIG.replace("version: 2\n", "version: 2\n    readVersion: 2\n"))
    scanner = Scanner(world.searcher(), world.store, clock=lambda: world.now[0])
    sort = (Sort("fields.n", True), Sort("fields.name"))
    seen, token, pages = [], "", 0
    while True:
        page = scanner.page(SearchRequest("a", sort=sort, page_size=7, page_token=token))
        seen += [r["id"] for r in page.hits.collect()]
        if not pages:
            assert page.total == 40
            world.tables.a["000"] = ("changed", 99)  # a scan doesn't see what is written meanwhile
            world.notify("updated", "a", "000", 2)
            world.run_until_settled()
        pages, token = pages + 1, page.next_token
        if not token:
            break
        last = token
    rows = {f"{i:03d}": (None if i % 5 == 0 else i % 4, f"n{i % 7}") for i in range(40)}
    assert seen == sorted(rows, key=lambda k: (rows[k][0] is None, -(rows[k][0] or 0), rows[k][1], k)) and pages == 6
    with pytest.raises(InvalidPageToken):
        scanner.page(SearchRequest("a", query="other", sort=sort, page_size=7, page_token=last))
    with pytest.raises(InvalidPageToken):
        scanner.page(SearchRequest("a", page_token="???"))
    world.now[0] += 3601
    with pytest.raises(CursorExpired):
        scanner.page(SearchRequest("a", sort=sort, page_size=7, page_token=last))
    world.store.point("a", "other_search_v1")
    with pytest.raises(ScanFault):
        scanner.page(SearchRequest("a"))
    assert scanner.page(SearchRequest("b", filters=(Filter("fields.state", "eq", "zzz"),))).next_token == ""


def test_fingerprints_differ_in_every_part():
    base = SearchRequest("a", "q", filters=(Filter("f", "eq", "v"),), sort=(Sort("s"),), scope="x")
    others = [
        SearchRequest("b", "q", filters=base.filters, sort=base.sort, scope="x"), SearchRequest("a", "r", filters=base.filters, sort=base.sort, scope="x"), SearchRequest("a", "q", sort=base.sort, scope="x"),
        SearchRequest("a", "q", filters=(Filter("f", "in", values=("v",)),), sort=base.sort, scope="x"), SearchRequest("a", "q", filters=base.filters, sort=(Sort("s", True),), scope="x"),
        SearchRequest("a", "q", filters=base.filters, sort=base.sort, scope="y"), SearchRequest("a", "qx", filters=base.filters, sort=base.sort, scope=""),
    ]
    assert len({fingerprint(r) for r in [base, *others]}) == len(others) + 1


def test_migration(world):
    assert migrate.verify_indices(world) == ["a_search_v1", "b_search_v1"]
    fill(world)
    assert migrate.converge(world) == {"a": "in-sync", "b": "in-sync"}
    gates = {r["gate"]: r["ok"] for r in migrate.cutover_readiness(world, "a", 2).collect()}
    assert list(gates) == list(migrate.GATES) and all(gates.values())
    world.notify("updated", "a", "1", 5)
    assert not {r["gate"]: r["ok"] for r in migrate.cutover_readiness(world, "a", 2).collect()}["stale-backlog"]
    assert migrate.live_diff(world, "a", 2).isEmpty()
    world.config = load(CONFIG.replace("{name: n, type: long}", "{name: n, type: long}, {name: extra}").replace("version: 2\n", "version: 2\n    readVersion: 2\n"))
    assert [tuple(r)[:2] for r in migrate.live_diff(world, "a", 2).collect()] == [("fields.extra", "added")]
    assert migrate.converge(world)["a"] == "forward" and world.store.alias("a") == ["a_search_v2"]
    world.config = load(CONFIG)
    with pytest.raises(InvalidArgument):
        migrate.converge(world)
    assert migrate.converge(world, force=True)["a"] == "backward"
    world.config = load(CONFIG.split("  - type: a\n    version: 2")[0] + "  - type: b\n    fields: [{name: state, query: {search: primary}}, {name: a_id}]\n")
    assert migrate.classify_indices(world) == {"a_search_v1": "keep", "a_search_v2": "remove", "b_search_v1": "keep"}
    assert migrate.cleanup(world) == ["a_search_v2"]
    assert migrate.classify_move("a", ["x"], 1) == "foreign" and migrate.classify_move("a", [], 1) == "create"
    assert parse_index("a_search_v0") is None and parse_index("x_y_search_v12") == ("x_y", 12)


def test_a_missing_index_is_empty(world):
    assert found(world) == set()


def test_log_folds_and_pins(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", ("k",), ("rank",))
    log.append(spark.createDataFrame([("a", 2, "x"), ("b", 1, "y")], "k string, rank long, v string"))
    pinned = log.manifest()["segments"]
    log.append(spark.createDataFrame([("a", 1, "old"), ("b", 1, "z")], "k string, rank long, v string"))
    assert {r["k"]: r["v"] for r in log.latest().collect()} == {"a": "x", "b": "z"}
    assert {r["k"]: r["v"] for r in log.latest(pinned).collect()} == {"a": "x", "b": "y"}
    log.compact()
    assert {r["k"]: r["v"] for r in log.latest().collect()} == {"a": "x", "b": "z"} and len(log.manifest()["segments"]) == 1
    assert {r["k"]: r["v"] for r in log.latest(pinned).collect()} == {"a": "x", "b": "y"}


def test_a_log_folds_its_segments_by_level(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/levels", ("k",), ("rank",))
    want, counts = {}, []
    for i in range(18):
        rows = [(f"k{i % 5}", i % 7, f"v{i}", i % 6 == 5), ("same", 1, f"v{i}", False)]
        log.append(spark.createDataFrame(rows, "k string, rank long, v string, deleted boolean"))
        counts.append(len(log.manifest()["segments"]))
        for k, rank, v, gone in rows:
            if k not in want or rank >= want[k][0]:
                want[k] = (rank, v, gone)
        if i == 8:
            pinned, then = log.manifest()["segments"], {k: v for k, (_, v, gone) in want.items() if not gone}
    assert counts == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5, 6, 7, 8, 2, 3, 4] and log.manifest()["levels"] == [1, 1, 0, 0]
    assert {r["k"]: r["v"] for r in log.latest().collect()} == {k: v for k, (_, v, gone) in want.items() if not gone}
    assert {r["k"]: r["v"] for r in log.latest(pinned).collect()} == then


def test_reconciliation(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    answer = lambda *rows: spark.createDataFrame(list(rows), "id string, outcome string")
    assert {tuple(r) for r in repair.reconcile(asked, answer(("a", "nil"))).collect()} == {("a", "nil"), ("b", "err")}
    for bad in (answer(("a", "doc"), ("a", "doc")), answer(("c", "doc"))):
        with pytest.raises(InvalidArgument):
            repair.reconcile(asked, bad)
    rows = spark.createDataFrame([("a", 1, "doc", None), ("a", 2, "err", "late"), ("b", 1, "nil", None), ("b", 2, "err", None)], "id string, version int, outcome string, error string")
    assert {tuple(r) for r in repair.merge_versions(rows).collect()} == {("a", 1, 0, "late"), ("b", 0, 1, "unanswered")}


def test_drift_and_claims(spark):
    state = spark.createDataFrame([("b", "1", 1, 0, 5, 7, 10.0, False, {}, None, None, 0, None), ("b", "2", 1, 0, None, 2, None, False, {}, 5, 900.0, 1, None)], st.STATE)
    built = spark.createDataFrame([("a", "x", [("b", "1")]), ("a", "y", [("b", "2")])], "type string, id string, children array<struct<type: string, id: string>>")
    assert [tuple(r) for r in st.drifted(built, state, 5).collect()] == [("a", "x")]
    assert [r["id"] for r in st.claim(state, 1000.0).collect()] == ["1"]
    tokens = spark.createDataFrame([("b", "2", 5)], "type string, id string, token long")
    failed = st.release(state, tokens, 1000.0, failed=True).first()
    assert (failed["sweep_attempts"], failed["sweep_after"], failed["owner_seq"]) == (2, 1600.0, None)
    assert st.renew(state, tokens, 950.0).first()["owner_since"] == 950.0
    assert st.release(state, tokens.withColumn("token", F.lit(6)), 1000.0).isEmpty()
    keys = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({},), (None,)], "m map<string,string>").select(st.canonical_metadata(F.col("m")))
    assert len({r[0] for r in keys.collect()}) == 2


def test_backoff(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 9, 10, 500)], "n int")
    assert [r[0] for r in df.select(st.backoff(F.col("n"))).collect()] == [300.0, 300.0, 600.0, 76800.0, 86400.0, 86400.0]
