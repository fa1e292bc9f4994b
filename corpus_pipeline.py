"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result to the shared folder
and reads it back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import row_key, table, written
from docweave.llm.linedup import dedup_lines
from docweave.llm.mixing import mix, word_count
from docweave.llm.pieces import Pieces, piece_counts
from docweave.llm.similar import similar_documents
from docweave.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD, by a model of the labels of the documents at hand."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=COLUMNS).where(F.col("score") < THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat; n_chars follows the text. A null text stays null."""
    out = dedup_lines(docs, keep=COLUMNS)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), that of the smallest doc_id.

    Of several rows of that id in the group the least one stays. Rows of one id, or of none, in different groups all stay.
    """
    found = similar_documents(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key = ["__id", "__hash"]
    kept = found.groupBy("root", row_key().alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept, "stage-least")
    often = kept.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root", F.lit(True).alias("__often"))
    kept = written(kept.drop("n").join(often, "root", "left").withColumnRenamed("root", "__root"), "stage-kept")
    rows = docs.select(*COLUMNS, row_key().alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__hash"))
    # nearly all groups have one such row; those rows aren't shuffled again to find the least
    single = rows.join(kept.where("__often is null"), key, "left_semi").select(*COLUMNS)
    several = rows.join(kept.where("__often"), key).groupBy("__root").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return single.unionByName(several)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A source that is below its target stays whole.

    Documents without words weigh nothing in the mix and stay once.
    """
    key = ["__id", "__source", "__size"]
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__source")
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("times"))
    taken = mix(docs).select(row_key().alias("__id"), named, F.col("size").alias("__size"), times.alias("times"))
    taken = written(taken.groupBy(*key).agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("__n")).where("times > 0"), "stage-times")
    rows = docs.select(*COLUMNS, row_key().alias("__id"), named, word_count(F.col("text")).alias("__size"))
    # joined in one way at every size: what a corpus takes is no broadcast
    single = rows.join(taken.where("__n = 1").hint("merge"), key).select(*COLUMNS, F.col("times").cast("int").alias("times"))
    # rows of one id, source and length are alike to the mix: they share its times, the first of them the odd ones
    several = rows.join(taken.where("__n > 1"), key).withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("text"))))
    share = F.expr("times div __n + if(__nth <= times % __n, 1, 0)").cast("int").alias("times")
    rows = single.unionByName(several.select(*COLUMNS, share)).where("times > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy")).drop("__copy")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces, counted and digested, and what decoding them gives."""
    return piece_counts(docs, Pieces.load())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Boosted trees and subset sums have no SQL form; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents that all stages before it kept, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
