"""Change notifications as a stream: the same folds as in batch, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from docweave.operators import state as st
from docweave.operators.engine import Engine


def one_per_resource(batch: DataFrame) -> list[DataFrame]:
    """A micro-batch as batches in which a resource comes once: the n-th holds every resource's n-th notification.

    Coalescing keeps them few: of a run of notifications between deletes only the one of the highest version can raise
    the version further than any, one without a version is accepted in any case, and of deletes in a row one is enough.
    """
    own = Window.partitionBy("type", "id").orderBy(*st.arrival())
    is_delete, version = F.col("kind") == "deleted", F.coalesce("version", F.lit(0))
    run = F.sum(F.when(is_delete != F.coalesce(F.lag(is_delete).over(own), ~is_delete), 1).otherwise(0)).over(own)
    turns = batch.withColumn("turn", 2 * run + F.when(~is_delete & (version == 0), 1).otherwise(0))
    rest = [c for c in batch.columns if c not in ("type", "id")]
    kept = turns.groupBy("type", "id", "turn").agg(F.max_by(F.struct(*rest), F.struct(version, "ord", "kind")).alias("r")).select("type", "id", "turn", "r.*")
    found = sorted(r[0] for r in kept.select("turn").distinct().collect())
    return [kept.where(F.col("turn") == i).drop("turn") for i in found]


def start(engine: Engine, notifications: DataFrame, checkpoint: str, build: bool = True, **trigger) -> StreamingQuery:
    """Registers, then builds, each micro-batch of a streaming DataFrame of notifications.

    Notifications carry an ord that follows their arrival. A micro-batch that is run again after a failure is judged by
    the version gate, and latest-wins logs make its builds repeatable. Without a trigger, all that is there is taken.
    """

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            for part in one_per_resource(batch):
                engine.register(part.drop("ord"))
            if build:
                engine.run_until_settled()
        finally:
            batch.unpersist()

    writer = notifications.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


GATED = "type string, id string, ord long, kind string, version long, accepted boolean, stored long"


def gate_stream(notifications: DataFrame) -> DataFrame:
    """The version gate as a stateful operator: every notification with accepted and the stored version after it.

    The state of a resource is one number, so it stays small whatever the number of its notifications; notifications of
    one micro-batch are taken in order of arrival, as in the batch gate.
    """

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else 0
        whole = pd.concat(list(rows))
        for pdf in [whole.assign(judged=whole["version"].fillna(0).astype("int64")).sort_values(["ord", "judged", "kind"])]:
            accepted, after = [], []
            for kind, version in zip(pdf["kind"], pdf["judged"]):
                ok = kind == "deleted" or version == 0 or version > stored
                stored = 0 if kind == "deleted" else max(stored, int(version))
                accepted.append(ok)
                after.append(stored)
            yield pdf.assign(accepted=accepted, stored=after)[["type", "id", "ord", "kind", "version", "accepted", "stored"]]
        state.update((stored,))

    rows = notifications.select("type", "id", "ord", "kind", "version")
    return rows.groupBy("type", "id").applyInPandasWithState(fold, GATED, "stored long", "append", GroupStateTimeout.NoTimeout)
