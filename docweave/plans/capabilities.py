"""What clients can do with each field: exactly what requests are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.config import Config, Field
from docweave.functions.predicates import operators

SCHEMA = "resource string, version int, is_read boolean, ord int, field string, type string, searchable boolean, sortable boolean, filter_ops string"


def field_capabilities(config: Config) -> list[tuple]:
    """A row for each field that a path can name: versions ascending, fields in declared order."""
    rows = []
    for resource in config.resources:
        for v in resource.ascending:
            found: list[tuple[str, Field, bool]] = [(f"fields.{f.name}", f, False) for f in v.fields]
            found += [(f"{r.resource}.{f.name}", f, r.reference) for r in v.relations for f in r.fields]
            found += [(f"{b.name}.{f.name}", f, False) for b in v.blocks for f in b.fields]
            for i, (path, f, reference) in enumerate(found):
                searchable = f.search in ("primary", "secondary") and not reference
                rows.append((resource.type, v.number, v.number == resource.read_version, i, path, f.type, searchable, f.type != "text" and not reference, ",".join(operators(f, reference))))
    return rows


def capabilities(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame(field_capabilities(config), SCHEMA)
