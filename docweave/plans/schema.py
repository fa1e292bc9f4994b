"""A version's documents as a Spark schema, and how two schemas differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import Field, Resource, Version

SPARK_TYPES = {
    "keyword": T.StringType(),
    "text": T.StringType(),
    "long": T.LongType(),
    "integer": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "date": T.TimestampType(),
    "boolean": T.BooleanType(),
    "ip": T.StringType(),
}
SECONDARY = T.ArrayType(T.StructType([T.StructField("text", T.ArrayType(T.StringType())), T.StructField("scope", T.ArrayType(T.StringType()))]))


def struct_of(fields: tuple[Field, ...], first: str | None = None) -> T.StructType:
    names = [T.StructField(first, T.StringType())] if first else []
    return T.StructType(names + [T.StructField(f.name, SPARK_TYPES[f.type], metadata={"type": f.type}) for f in fields if f.name != first])


def document_schema(version: Version) -> T.StructType:
    """resource_id, fields, every denormalised relation (a struct or an array of structs), blocks, and the two search surfaces."""
    parts = [T.StructField("resource_id", T.StringType()), T.StructField("fields", struct_of(version.fields))]
    for r in version.denormalized:
        row = struct_of(r.fields, "id")
        parts.append(T.StructField(r.resource, T.ArrayType(row) if r.many else row))
    for b in version.blocks:
        parts.append(T.StructField(b.name, T.ArrayType(struct_of(b.fields, b.scope_key))))
    parts += [T.StructField("search_primary", T.ArrayType(T.StringType())), T.StructField("search_secondary", SECONDARY)]
    return T.StructType(parts)


def schemas(resource: Resource) -> dict[int, T.StructType]:
    return {v.number: document_schema(v) for v in resource.ascending}


def paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted path, type) of every leaf and container of a schema."""
    found = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        inner = kind.elementType if nested else kind
        if isinstance(inner, T.StructType):
            found.append((path, "nested" if nested else "object"))
            found += paths(inner, path + ".")
        else:
            found.append((path, f.metadata.get("type") or kind.simpleString()))
    return found


def schema_diff(spark: SparkSession, wanted: T.StructType, live: T.StructType) -> DataFrame:
    """path, change (added, changed, removed), wanted, live: a full outer join of the two schemas' paths.

    Added and changed paths are drift; removed ones, which the live schema alone has, are for information.
    """
    left = spark.createDataFrame(paths(wanted) or [], "path string, wanted string")
    right = spark.createDataFrame(paths(live) or [], "path string, live string")
    change = F.when(F.col("live").isNull(), "added").when(F.col("wanted").isNull(), "removed").when(F.col("wanted") != F.col("live"), "changed")
    return left.join(right, "path", "full").withColumn("change", change).where(F.col("change").isNotNull()).select("path", "change", "wanted", "live")


def drifted(diff: DataFrame) -> bool:
    return not diff.where(F.col("change") != "removed").isEmpty()
