"""Storage: append-only Parquet logs read through a latest-wins view, indices behind aliases."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import InvalidArgument
from docweave.sources import files

#: Segments of one level that an append folds into one of the next.
FAN = 8


@dataclass
class Log:
    """Rows of some keys, appended in segments; a small manifest lists the segments that count.

    Every append gets the next write order. The latest view keeps, for each key, the row of the highest `rank` columns,
    of equal ones the last written; a row with deleted = true hides its key. Grouping combines before it shuffles, so a
    key written very often is no bottleneck. The last FAN segments of one level become one of the next as soon as there
    are so many, so n appends leave some FAN * log n segments and write each row log n times. A reader holds a list of
    segments, so compaction doesn't disturb it.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    rank: tuple[str, ...] = ()

    def manifest(self) -> dict:
        return files.read_json(self.spark, f"{self.path}/manifest.json", {"segments": [], "next": 0, "schema": None})

    def append(self, rows: DataFrame) -> int:
        """Adds rows (deleted defaults to false) as one segment; what a failed write leaves is in no manifest."""
        held = self.manifest()
        order = held["next"]
        if "deleted" not in rows.columns:
            rows = rows.withColumn("deleted", F.lit(False))
        rows = rows.withColumn("write_ord", F.lit(order).cast("long"))
        segment = f"segment-{order:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{segment}")
        levels = [*held.get("levels", [0] * len(held["segments"])), 0]
        self._list({"segments": [*held["segments"], segment], "levels": levels, "next": order + 1, "schema": rows.schema.json()})
        while len(levels) >= FAN and levels[-FAN] == levels[-1]:
            levels = self._fold(FAN)
        return order

    def _list(self, manifest: dict) -> None:
        files.write_json(self.spark, f"{self.path}/manifest.json", manifest)

    def _fold(self, n: int, keep_deleted: bool = True) -> list[int]:
        """Replaces the last n segments by one of the next level with their latest rows; returns the levels then."""
        held = self.manifest()
        levels = held.get("levels", [0] * len(held["segments"]))
        folded = latest(self.rows(held["segments"][-n:]), self.keys, self.rank, True, write_order=True)
        if not keep_deleted:
            folded = folded.where(~F.col("deleted"))
        segment = f"segment-{held['next']:012d}-{uuid.uuid4().hex}"
        folded.write.parquet(f"{self.path}/{segment}")
        levels = [*levels[:-n], max(levels[-n:]) + 1]
        self._list({**held, "segments": [*held["segments"][:-n], segment], "levels": levels, "next": held["next"] + 1})
        return levels

    def rows(self, segments: list[str] | None = None) -> DataFrame | None:
        """All rows of the segments (by default those of the manifest), None if nothing was ever written."""
        held = self.manifest()
        if not held["schema"]:
            return None
        schema = T.StructType.fromJson(json.loads(held["schema"]))
        names = held["segments"] if segments is None else segments
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{s}" for s in names])

    def latest(self, segments: list[str] | None = None, deleted: bool = False) -> DataFrame | None:
        rows = self.rows(segments)
        return None if rows is None else latest(rows, self.keys, self.rank, deleted)

    def compact(self, keep_deleted: bool = True) -> None:
        """Replaces all segments by one with the latest rows. Tombstones stay, or a late older write would be seen again."""
        n = len(self.manifest()["segments"])
        if n > 1:
            self._fold(n, keep_deleted)


def latest(rows: DataFrame, keys: tuple[str, ...], rank: tuple[str, ...] = (), deleted: bool = False, write_order: bool = False) -> DataFrame:
    """For each key the row of the highest rank, then of the highest write_ord; without tombstones unless asked for."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in (*rank, "write_ord")])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")
    if not deleted:
        best = best.where(~F.col("deleted")).drop("deleted")
    return best if write_order else best.drop("write_ord")


def index_name(resource: str, version: int) -> str:
    return f"{resource}_search_v{version}"


def alias_name(resource: str) -> str:
    return f"{resource}_search"


def parse_index(name: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"(.+)_search_v([1-9]\d*)", name)
    return (m[1], int(m[2])) if m else None


@dataclass
class DocumentStore:
    """Indices of documents, one for each type and version, and the aliases that searches read them by."""

    spark: SparkSession
    root: str

    def log(self, resource: str, version: int) -> Log:
        return Log(self.spark, f"{self.root}/indices/{index_name(resource, version)}", ("id",), ("build_seq",))

    def upsert(self, resource: str, version: int, docs: DataFrame, build_seq: int | None = None) -> None:
        """docs: id and the document's columns, and build_seq unless it is given. An older build never shows over a newer one."""
        if build_seq is not None:
            if build_seq <= 0:
                raise InvalidArgument(f"a build sequence must be above 0, not {build_seq}")
            docs = docs.withColumn("build_seq", F.lit(build_seq).cast("long"))
        docs = docs.withColumn("resource_id", F.col("id").cast("string"))
        self.log(resource, version).append(docs)

    def delete(self, resource: str, version: int, ids: DataFrame, build_seq: int | None = None) -> None:
        """Tombstones at a build sequence: they hide what is as old or older, never a newer document."""
        log = self.log(resource, version)
        held = log.rows()
        ids = ids.withColumn("build_seq", F.lit(build_seq).cast("long")) if build_seq is not None else ids
        if held is None:
            return
        schema = held.schema
        rest = [F.lit(None).cast(schema[c].dataType).alias(c) for c in held.columns if c not in ("id", "build_seq", "deleted", "write_ord")]
        log.append(ids.select("id", *rest, F.col("build_seq").cast("long"), F.lit(True).alias("deleted")).select(*[c for c in held.columns if c != "write_ord"]))

    def documents(self, resource: str, version: int, segments: list[str] | None = None) -> DataFrame | None:
        found = self.log(resource, version).latest(segments)
        return None if found is None else found.drop("build_seq")

    def count(self, resource: str, version: int) -> int:
        found = self.documents(resource, version)
        return 0 if found is None else found.count()

    def exists(self, resource: str, version: int) -> bool:
        return self.log(resource, version).manifest()["schema"] is not None

    def mapping(self, resource: str, version: int) -> T.StructType | None:
        """The schema that an index was made for, field types included; None where it was never put."""
        found = files.read_json(self.spark, f"{self.root}/mappings/{index_name(resource, version)}.json", None)
        return None if found is None else T.StructType.fromJson(found)

    def put_mapping(self, resource: str, version: int, schema: T.StructType) -> None:
        files.write_json(self.spark, f"{self.root}/mappings/{index_name(resource, version)}.json", json.loads(schema.json()))

    def indices(self) -> list[str]:
        return [n for n in files.listing(self.spark, f"{self.root}/indices") if parse_index(n)]

    def drop(self, index: str) -> None:
        files.remove(self.spark, f"{self.root}/indices/{index}")
        files.remove(self.spark, f"{self.root}/mappings/{index}.json")

    # aliases

    def alias(self, resource: str) -> list[str]:
        return files.read_json(self.spark, f"{self.root}/aliases/{alias_name(resource)}.json", [])

    def point(self, resource: str, index: str) -> None:
        files.write_json(self.spark, f"{self.root}/aliases/{alias_name(resource)}.json", [index])

    def read(self, resource: str) -> DataFrame | None:
        """The documents behind the alias; None without an alias or an index, which is an empty result, not an error."""
        targets = self.alias(resource)
        parsed = parse_index(targets[0]) if len(targets) == 1 else None
        return None if parsed is None else self.documents(*parsed)
