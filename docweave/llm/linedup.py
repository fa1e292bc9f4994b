"""Operator 8: line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import blocks, row_key, shared_dir, table, with_text, written

MIN_LENGTH = 20
MIN_DOCS = 3
#: Batches that a table is taken in, and runs on a level before they are merged into one on the next.
BATCHES = 4
FANOUT = 3
#: Bytes of text that are rebuilt together.
BLOCK = 2 << 20

SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = str.maketrans(UPPER, LOWER)


def line_key(line):
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def digest(key):
    return F.unhex(F.md5(key.cast("binary")))


def keyed_lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """id, key: each document's distinct digests of line keys of at least min_length code points."""
    lines = docs.select(row_key().alias("id"), F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line"))
    keys = lines.select("id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keys.select("id", digest(F.col("key")).alias("key")).distinct()


class LineRuns:
    """Levelled sorted runs of line digests in a shared folder.

    A run is a Parquet table (key, docs, last) sorted by key within its files: how many documents of a batch hold the line
    and the largest id among them. Batches must hold different documents, so that counts add up. add() merge-anti-joins a
    batch with the runs: keys that no run holds become the batch's own run on level 0, so a key is in one run only; keys
    that one holds already go, with their counts, to the repeats. When a level has `fanout` runs, they are merged into one
    run on the next level, so a digest is rewritten once for each level and there are at most `fanout` - 1 runs on each.
    The list of runs is one small JSON value in memory, saved by describe(); runs are never changed once written, so a
    lost executor or a failed job leaves a whole state behind.
    """

    SCHEMA = "key binary, docs long, last long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, levels: list[list[str]] | None = None, repeats: list[str] | None = None):
        self.spark, self.fanout = spark, fanout
        self.levels, self.repeated = levels or [[]], repeats or []
        self.folder = shared_dir(spark)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def _path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/line-{name}-{uuid.uuid4().hex}"

    def _put(self, rows: DataFrame, level: int) -> str:
        path = self._path(f"run-{level}")
        rows.sortWithinPartitions("key").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # no key is in two runs: merging them is putting their rows in one order
            self._put(self._read(full).repartition("key"), level + 1)
        return path

    def rows(self) -> DataFrame:
        """key, docs, last over all batches, one row for each key: what the runs hold, and the repeats of it."""
        more = self._read(self.repeated).groupBy("key").agg(F.sum("docs").alias("__docs"), F.max("last").alias("__last"))
        held = self._read([p for level in self.levels for p in level]).join(more, "key", "left")
        return held.select("key", (F.col("docs") + F.coalesce("__docs", F.lit(0))).alias("docs"), F.greatest("last", "__last").alias("last"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Takes in a batch, (id, key) with each pair once, of documents that no earlier batch held.

        Returns the fresh keys, those that no earlier batch had, which is what a feed that only wants new lines goes by.
        """
        batch = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"))
        held = [p for level in self.levels for p in level]
        if not held:
            return self._read([self._put(batch, 0)]).select("key")
        batch = written(batch, "line-batch")
        seen = self._read(held).select("key")
        path = self._path("repeats")
        batch.join(seen.hint("merge"), "key", "left_semi").write.parquet(path)
        self.repeated.append(path)
        return self._read([self._put(batch.join(seen.hint("merge"), "key", "left_anti"), 0)]).select("key")

    def describe(self) -> str:
        return json.dumps({"fanout": self.fanout, "levels": self.levels, "repeats": self.repeated})


def _rebuild(schema: T.StructType, kept: int, text_at: int):
    """Batches of the columns to keep, the digests to drop, and the text at text_at -> those kept, counts, and the new text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, text_at, BLOCK)):
            out = []
            for text, drops in zip(batch.column(text_at).to_pylist(), batch.column(kept).to_pylist()):
                text = text or ""
                n, dropped = text.count("\n") + 1, 0
                if drops:
                    gone, lines = set(drops), text.split("\n")
                    keep = [x for x in lines if hashlib.md5(x.strip(SPACE).translate(_LOW).encode()).digest() not in gone]
                    dropped, text = n - len(keep), "\n".join(keep)
                out.append((n, dropped, text))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], [f.name for f in schema])

    return run


def dedup_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns to keep, n_lines, n_dropped, kept (the text that stays).

    A line whose key has at least min_length code points and is found in at least min_docs documents goes from every
    document but the one of the largest doc_id that holds it, where all its copies stay. A null or empty text is one
    empty line. Rows that share a doc_id count as one document and lose the same lines; a null doc_id counts as one
    that is smaller than all others and stays null in the result. An empty table gives an empty result. Other columns
    of docs are not looked at. Lines are compared by 128-bit digests.

    Texts are shuffled once, to meet the digests they lose; a hot line is one row for each document that holds it,
    counted before and after the shuffle, and the join that finds its documents is one adaptive execution can split.
    """
    spark = docs.sparkSession
    keys = written(keyed_lines(docs, min_length).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "line-keys")
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).select("id", "key"))
    common = written(runs.rows().where(F.col("docs") >= min_docs).select("key", "last"), "line-common")
    drops = keys.select("id", "key").join(common, "key").where("id < last").groupBy("id").agg(F.collect_list("key").alias("drops"))
    gone = drops.withColumnsRenamed({"id": "__id", "drops": "__drops"})
    own = docs.select(*dict.fromkeys([*keep, "text"]), row_key().alias("__id"))
    met, text_at = with_text(own.join(gone, "__id", "left"), keep, [F.col("__drops")])
    made = T.StructType.fromDDL("n_lines long, n_dropped long, kept string")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in met.schema.fields[: len(keep)]] + list(made))
    return met.mapInArrow(_rebuild(schema, len(keep), text_at), schema)


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines before and after dedup, and a digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
