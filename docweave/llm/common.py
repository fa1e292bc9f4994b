"""What the operators of this subpackage share: reading, shared storage, scalable ranks, components.

In all of them a doc_id of -2**63 is the same as none: it is what stands for a null inside.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one task ranks at most, on average, when a class of rows is numbered.
RANK_BLOCK = 10_000

#: Stands for a null doc_id in joins and orders; such a row sorts before all others.
NULL_ID = -(1 << 63)


def blocks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a string column (one row at least): what is made of a slice stays small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_text(df: DataFrame, keep: tuple[str, ...], more: list) -> tuple[DataFrame, int]:
    """The columns to keep, then `more`, then the text unless it is a string column that is kept; and where the text is.

    So a text goes to a Python worker once, whether it is kept or not.
    """
    kept = df.select(*keep)
    if "text" in keep and kept.schema["text"].dataType == T.StringType():
        return df.select(*keep, *more), keep.index("text")
    return df.select(*keep, *more, F.col("text").cast("string").alias("__text")), len(keep) + len(more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the sample tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session (tests) gets a temporary folder; a cluster, whose executors would each write to a
    disk of their own, is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(base)
        return base
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends here and a lost executor costs nothing.

    What was written goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id="doc_id"):
    """The id that stands for a row in joins and orders; a null one (and -2**63 itself, which no table uses) is NULL_ID."""
    return F.coalesce(F.col(doc_id), F.lit(NULL_ID))


def ranked(df: DataFrame, keys: list[str], order: list, count: str, rank: str = "rank", block: int = RANK_BLOCK) -> DataFrame:
    """Numbers the rows of each class 0, 1, 2, ... without gaps, in column rank.

    keys name the class, which must not be null; column count holds the class's number of rows. At every size rows are in
    order of the hash of the order columns, then of these. Each class is cut into ranges of the hash of about `block` rows;
    each is numbered in its own task and shifted by the sizes of those before it, so no task holds a whole class. Rows that
    are equal in all columns are one row, with a number, until they are numbered. The numbering is a function of the rows alone.
    """
    salt, shift, at, same = "__salt", "__shift", "__at", "__same"
    part = F.shiftright(F.shiftrightunsigned(F.col(at), 33) * F.ceil(F.col(count) / F.lit(block)), 31)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(same)).withColumn(at, F.xxhash64(*order).bitwiseXOR(F.lit(NULL_ID))).withColumn(salt, part)
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(*keys, salt).agg(F.sum(same).alias("__n")).select(*keys, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(shift))
    own = Window.partitionBy(*keys, salt).orderBy(F.col(at).bitwiseXOR(F.lit(NULL_ID)), *order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn(rank, F.coalesce(F.sum(same).over(own), F.lit(0))).join(shifts, [*keys, salt])
    first = F.col(rank) + F.col(shift)
    return numbered.select(*df.columns, F.explode(F.sequence(first, first + F.col(same) - 1)).alias(rank))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the edges (u long, v long): rows (node, root), root the smallest node that node reaches.

    Alternating large-star and small-star steps: every step is a grouped minimum (combined before its shuffle) and an
    equi-join that adaptive execution can split where a node has very many neighbours. Each round is cut by a reliable
    checkpoint. Nodes without an edge do not appear; loops are ignored.
    """
    shared_dir(edges.sparkSession)
    known = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        state = known.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
