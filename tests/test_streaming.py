from __future__ import annotations

import random

from docweave.operators import state as st
from docweave.operators.engine import Engine
from docweave.streaming.driver import gate_stream, one_per_resource, start
from tests.test_engine import CONFIG, Tables, load


def log_rows(n: int = 200):
    rng = random.Random(1)
    kinds = ["created", "updated", "updated", "deleted"]
    return [(rng.choice(kinds), "a", str(rng.randint(1, 6)), {}, rng.choice([0, 1, 2, 3, 5, 8, 13]), i) for i in range(n)]


def fold(rows):
    """The gate, one notification after the other."""
    stored, out = {}, []
    for kind, t, i, _, version, _ord in rows:
        before = stored.get((t, i), 0)
        ok = kind == "deleted" or version == 0 or before < version
        stored[(t, i)] = 0 if kind == "deleted" else max(before, version)
        out.append((i, _ord, ok, stored[(t, i)]))
    return out, stored


def test_gate_in_batch(spark):
    rows = log_rows()
    found = sorted(((r["id"], r["ord"], r["accepted"], r["stored"]) for r in st.gate(spark.createDataFrame(rows, st.NOTIFICATION)).collect()), key=lambda r: r[1])
    assert found == fold(rows)[0]


def test_gate_over_a_stream(spark, tmp_path):
    rows = log_rows()
    folder = f"file://{tmp_path}/in"
    for i in range(0, 200, 50):
        spark.createDataFrame(rows[i : i + 50], st.NOTIFICATION).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(st.NOTIFICATION).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    query = gate_stream(stream).writeStream.format("memory").queryName("gated").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.awaitTermination(120)
    found = sorted(((r["id"], r["ord"], r["accepted"], r["stored"]) for r in spark.table("gated").collect()), key=lambda r: r[1])
    assert found == fold(rows)[0]


def test_turns_of_a_batch_lead_to_the_same_state(spark):
    rows = log_rows(60)
    turns = [r for part in one_per_resource(spark.createDataFrame(rows, st.NOTIFICATION)) for r in [[tuple(x) for x in part.select("kind", "type", "id", "metadata", "version", "ord").collect()]]]
    assert all(len({r[2] for r in turn}) == len(turn) for turn in turns)
    assert fold([r for turn in turns for r in turn])[1] == fold(rows)[1]


def test_stream_and_batch_lead_to_the_same_documents(spark, tmp_path):
    tables = Tables(spark)
    engines = [Engine(spark, load(CONFIG), tables.sources(), f"file://{tmp_path}/root{i}") for i in range(2)]
    rows = [("created", "a", "1", {}, 1, 0), ("created", "b", "10", {}, 1, 1), ("updated", "a", "1", {}, 2, 2), ("created", "a", "2", {}, 1, 3), ("deleted", "a", "2", {}, 0, 4)]
    folder = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, st.NOTIFICATION).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(st.NOTIFICATION).parquet(folder)
    query = start(engines[0], stream, f"file://{tmp_path}/checkpoint")
    assert query.awaitTermination(300)
    for row in rows:
        engines[1].register(spark.createDataFrame([row], st.NOTIFICATION))
    engines[1].run_until_settled()
    found = [sorted((r["id"], r["fields"]["name"], len(r["b"])) for r in e.store.documents("a", 1).collect()) for e in engines]
    assert found[0] == found[1] == [("1", "one", 2)]
    assert all(e.state().where("stale_seq is not null").isEmpty() for e in engines)


def tied_rows(n: int = 400):
    """Notifications of which several of a resource share an ord; a sorted list is the order of arrival."""
    rng = random.Random(2)
    rows = [(rng.choice(["created", "updated", "deleted"]), "a", str(rng.randint(1, 4)), {}, rng.randint(1, 9), rng.randint(0, 40)) for _ in range(n)]
    return sorted(rows, key=lambda r: (r[5], r[4], r[0])), rows


def test_gate_in_batch_breaks_ties(spark):
    arrival, rows = tied_rows()
    want = sorted(fold(arrival)[0])
    for asked in (rows, arrival[::-1]):
        log = spark.createDataFrame(asked, st.NOTIFICATION)
        assert sorted((r["id"], r["ord"], r["accepted"], r["stored"]) for r in st.gate(log).collect()) == want


def test_gate_over_a_stream_breaks_ties(spark, tmp_path):
    arrival, rows = tied_rows()
    spark.createDataFrame(rows[::-1], st.NOTIFICATION).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(st.NOTIFICATION).parquet(f"file://{tmp_path}/in")
    query = gate_stream(stream).writeStream.format("memory").queryName("tied").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    query.awaitTermination(120)
    assert sorted((r["id"], r["ord"], r["accepted"], r["stored"]) for r in spark.table("tied").collect()) == sorted(fold(arrival)[0])


def test_turns_of_a_batch_break_ties(spark):
    arrival, rows = tied_rows(60)
    turns = [[tuple(x) for x in part.select("kind", "type", "id", "metadata", "version", "ord").collect()] for part in one_per_resource(spark.createDataFrame(rows[::-1], st.NOTIFICATION))]
    assert fold([r for turn in turns for r in turn])[1] == fold(arrival)[1]
