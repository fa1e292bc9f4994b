"""Where rows of a resource type come from: a DataFrame for each type, with an id column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.errors import UnknownResource


@dataclass
class Sources:
    """Types and their rows. A row is an id, as a string, and the columns that configurations name.

    A listing is the whole DataFrame; fetching by ids is a left join, so that an id without a row is answered by an
    explicit nothing; fetching related rows is an equi-join on a column. All keys are compared as strings.
    """

    spark: SparkSession
    rows: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def add(self, type_: str, rows: DataFrame | Callable[[], DataFrame], id_: str | Column = "id", columns: dict[str, str | Column] | None = None) -> Sources:
        """Registers a type. columns maps field names to columns of rows; without it all columns are kept."""

        def read() -> DataFrame:
            df = rows() if callable(rows) else rows
            key = F.col(id_) if isinstance(id_, str) else id_
            if columns is None:
                return df.withColumn("id", key.cast("string"))
            picked = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items() if n != "id"]
            return df.select(key.cast("string").alias("id"), *picked)

        self.rows[type_] = read
        return self

    def check(self, type_: str) -> None:
        if type_ not in self.rows:
            raise UnknownResource(f"no source for {type_!r}")

    def listing(self, type_: str) -> DataFrame:
        self.check(type_)
        return self.rows[type_]()

    def by_ids(self, type_: str, ids: DataFrame) -> DataFrame:
        """One row for each row of ids (id, and any others): found says whether the source has it."""
        have = self.listing(type_).withColumn("found", F.lit(True))
        return ids.join(have, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def related(self, type_: str, foreign: str, keys: DataFrame) -> DataFrame:
        """The rows of a type whose foreign column is one of keys (key)."""
        rows = self.listing(type_)
        return rows.join(keys.select(F.col("key").cast("string").alias("__key")).distinct(), rows[foreign].cast("string") == F.col("__key"), "left_semi")

    def after(self, type_: str, after: str | None, limit: int) -> DataFrame:
        """A page of a listing in order of id, for walks that can be resumed: the ids above `after`."""
        rows = self.listing(type_)
        if after is not None:
            rows = rows.where(F.col("id") > after)
        return rows.orderBy("id").limit(limit)


def parquet_tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
