"""Documents of a schema version, as one DataFrame plan over the sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.config import Config, Field, Relation, Resource, Version
from docweave.plans.schema import SPARK_TYPES
from docweave.sources.registry import Sources

#: Other document columns that a plan may bring: (Sources, roots with id) -> DataFrame with id and the array column.
BlockPlan = Callable[[Sources, DataFrame], DataFrame]


def typed(rows: DataFrame, field: Field) -> Column:
    """The field as its configured type, an array of it where rows hold arrays, null where rows don't have it.

    A value that can't be read as the type becomes null.
    """
    kind = SPARK_TYPES[field.type]
    if field.name not in rows.columns:
        return F.lit(None).cast(kind).alias(field.name)
    have, value = rows.schema[field.name].dataType, F.col(field.name)
    while isinstance(have, T.ArrayType) and isinstance(have.elementType, T.ArrayType):  # arrays in arrays are one
        have, value = have.elementType, F.flatten(F.filter(value, lambda x: x.isNotNull()))
    if isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: x.try_cast(kind)).alias(field.name)
    return (F.col(field.name) if have == kind else F.col(field.name).try_cast(kind)).alias(field.name)


def _key(column: Column) -> Column:
    """A join key: as a string; an empty one joins nothing."""
    return F.nullif(column.cast("string"), F.lit(""))


def _texts(value: Column, kind: T.DataType) -> Column:
    """The texts of one value: nothing for null or empty, every element of an array (empty strings too), others as strings."""
    listed = isinstance(kind, T.ArrayType)
    parts = F.transform(value if listed else F.array(value), lambda x: x.cast("string"))
    texts = F.filter(parts, lambda x: x.isNotNull() if listed else x.isNotNull() & (x != ""))
    return F.coalesce(texts, F.array().cast("array<string>"))


def _kind(schema: T.StructType, name: str) -> T.DataType:
    return schema[name].dataType


def _tier_texts(value: Column, schema: T.StructType, fields: tuple[Field, ...], tier: str) -> list[Column]:
    return [_texts(value[f.name], _kind(schema, f.name)) for f in fields if f.search == tier]


def _join_relation(docs: DataFrame, relation: Relation, rows: DataFrame, carried: list[str], some: bool) -> DataFrame:
    """docs with a column of the relation's rows, and, in __first_<name>, the raw keys of its first row for siblings.

    A related row's first is that of the smallest id, then of the smallest fields. The children are grouped by key with
    the combining done before the join, so each side is shuffled once, by the join key. Where only some roots are built,
    only children of their keys are.
    """
    name, foreign = relation.resource, relation.join.foreign
    picked = [typed(rows, f) for f in relation.fields if f.name != "id"]
    raw = [_key(F.col(c)).alias(f"__raw_{c}") if c in rows.columns else F.lit(None).cast("string").alias(f"__raw_{c}") for c in carried]
    child = rows.where(_key(F.col(foreign)).isNotNull()).select(_key(F.col(foreign)).alias("__key"), F.struct(F.col("id"), *picked).alias("__row"), F.struct(*raw, F.lit(1).alias("__one")).alias("__raw"))
    first = F.min(F.struct("__row", "__raw")).alias("__first")
    every = [F.sort_array(F.collect_list("__row")).alias("__rows")] if relation.many else []
    source = relation.join.source
    local = F.col(f"__first_{source}")["__raw"][f"__raw_{relation.join.local}"] if source else _key(F.col("__root")[relation.join.local])
    if some:
        asked = docs.select(local.alias("__asked")).where("__asked is not null").distinct()
        child = child.join(asked, child["__key"] == asked["__asked"], "left_semi")
    grouped = child.groupBy("__key").agg(first, *every)
    joined = docs.withColumn("__local", local).join(grouped, F.col("__local") == F.col("__key"), "left")
    if relation.many:
        empty = F.array().cast(joined.schema["__rows"].dataType)
        value = F.coalesce(F.col("__rows"), empty)
    else:
        value = F.col("__first")["__row"]
    return joined.withColumn(name, value).withColumn(f"__first_{name}", F.col("__first")).drop("__local", "__key", "__first", "__rows")


def documents(
    config: Config, sources: Sources, resource: str, version: int | None = None, ids: DataFrame | None = None, blocks: dict[str, BlockPlan] | None = None, secondary: BlockPlan | None = None
) -> DataFrame:
    """One row for each root: id, found, and the document's columns (see document_schema).

    Without ids the whole listing is built. With ids (a column id) every asked id is answered once, a root that the
    source doesn't have by found = false and an otherwise empty row. Reference relations are not fetched. A `one`
    relation without a row is null, a `many` relation without rows an empty array; surfaces without text are null.
    blocks and secondary bring what only a plan knows: entries of nested blocks, and secondary entries with a scope.
    """
    found = config.resource(resource)
    v = found.version(version)
    rows = sources.listing(resource) if ids is None else sources.by_ids(resource, ids.select("id").distinct())
    if "found" not in rows.columns:
        rows = rows.withColumn("found", F.lit(True))
    needed = {r.join.local for r in v.denormalized if not r.join.source}
    fields = F.struct(*[typed(rows, f) for f in v.fields]) if v.fields else F.struct(F.lit(None).cast("string").alias("__none"))
    root = F.struct(F.col("id"), *[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in sorted(needed - {"id"})])
    docs = rows.select("id", "found", fields.alias("fields"), root.alias("__root"))
    for r in v.denormalized:
        carried = sorted({x.join.local for x in v.denormalized if x.join.source == r.resource})
        docs = _join_relation(docs, r, sources.listing(r.resource), carried, ids is not None)
    for b in v.blocks:
        plan = (blocks or {}).get(b.name)
        if plan is not None:
            docs = docs.join(plan(sources, docs.select("id")).select("id", b.name), "id", "left")
        else:
            docs = docs.withColumn(b.name, F.lit(None).cast(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (b.scope_key, *(f.name for f in b.fields))]))))
    docs = _with_surfaces(docs, v)
    if secondary is not None:
        more = secondary(sources, docs.select("id")).select("id", F.col("search_secondary").alias("__more"))
        docs = docs.join(more, "id", "left").withColumn("search_secondary", F.coalesce(F.concat("search_secondary", "__more"), "search_secondary", "__more"))
    columns = ["fields", *(r.resource for r in v.denormalized), *(b.name for b in v.blocks), "search_primary", "search_secondary"]
    return docs.select("id", "found", F.when(F.col("found"), F.col("id")).alias("resource_id"), *[F.col(c) for c in columns])


def _of_row(row: T.StructType, fields: tuple[Field, ...], tier: str, make: Callable[[list[Column]], Column]) -> Callable[[Column], Column]:
    return lambda x: make(_tier_texts(x, row, fields, tier))


def _with_surfaces(docs: DataFrame, v: Version) -> DataFrame:
    schema = docs.schema
    fields_schema = schema["fields"].dataType
    strings = F.array().cast("array<string>")
    primary = _tier_texts(F.col("fields"), fields_schema, v.fields, "primary")
    own = _tier_texts(F.col("fields"), fields_schema, v.fields, "secondary")
    entry = lambda parts: F.struct(F.flatten(F.array(*parts)).alias("text"), strings.alias("scope"))
    entries = [F.array(entry(own))] if own else []
    for r in v.denormalized:
        kind = schema[r.resource].dataType
        row = kind.elementType if r.many else kind
        rows = F.col(r.resource) if r.many else F.when(F.col(r.resource).isNotNull(), F.array(F.col(r.resource))).otherwise(F.array().cast(T.ArrayType(row)))
        if any(f.search == "primary" for f in r.fields):
            primary.append(F.flatten(F.transform(rows, _of_row(row, r.fields, "primary", lambda parts: F.flatten(F.array(*parts))))))
        if any(f.search == "secondary" for f in r.fields):
            entries.append(F.transform(rows, _of_row(row, r.fields, "secondary", entry)))
    first = F.flatten(F.array(*primary)) if primary else strings
    docs = docs.withColumn("search_primary", F.when(F.size(first) > 0, first))
    if not entries:
        return docs.withColumn("search_secondary", F.lit(None).cast("array<struct<text: array<string>, scope: array<string>>>"))
    second = F.filter(F.concat(*entries), lambda e: F.size(e["text"]) > 0)
    return docs.withColumn("search_secondary", F.when(F.size(second) > 0, second))


def _link(name: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(name).alias("type"), x["id"].alias("id"))


def edges(config: Config, built: DataFrame, resource: str, version: int | None = None) -> DataFrame:
    """id, children: the (type, id) of every row copied into each document, once each; empty arrays count as an answer."""
    v = config.resource(resource).version(version)
    empty = F.array().cast("array<struct<type: string, id: string>>")
    parts = []
    for r in v.denormalized:
        rows = F.col(r.resource) if r.many else F.when(F.col(r.resource).isNotNull(), F.array(F.col(r.resource)))
        parts.append(F.coalesce(F.transform(rows, _link(r.resource)), empty))
    children = F.array_distinct(F.filter(F.flatten(F.array(*parts)), lambda x: x["id"].isNotNull() & (x["id"] != ""))) if parts else empty
    return built.select("id", children.alias("children"))


def reverse_relations(config: Config) -> dict[str, list[tuple[str, str]]]:
    """child type -> (parent type, the child's column that holds the parent's id): relations that a child can follow back.

    Only a join of the parent's own id without a sibling between can be turned round; references copy nothing.
    """
    found: dict[str, list[tuple[str, str]]] = {}
    for resource in config.resources:
        for v in resource.ascending:
            for r in v.relations:
                link = (resource.type, r.join.foreign)
                if r.join.local == "id" and not r.join.source and not r.reference and link not in found.setdefault(r.resource, []):
                    found[r.resource].append(link)
    return {k: x for k, x in found.items() if x}


def parent_links(config: Config, sources: Sources, child: str, ids: DataFrame) -> DataFrame:
    """type, id, ctype, cid: the parents that rows of a child type name themselves, once each."""
    rows = sources.listing(child).join(ids.select("id").distinct(), "id", "left_semi")
    found = None
    for parent, foreign in reverse_relations(config).get(child, []):
        part = rows.select(F.lit(parent).alias("type"), _key(F.col(foreign)).alias("pid"), F.lit(child).alias("ctype"), F.col("id").alias("cid")).where(F.col("pid").isNotNull())
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "type string, id string, ctype string, cid string")
    return found.withColumnRenamed("pid", "id").distinct()


def parents_of(config: Config, sources: Sources, child: str, ids: DataFrame) -> DataFrame:
    return parent_links(config, sources, child, ids).select("type", "id").distinct()


def resource_documents(config: Config, sources: Sources, resource: Resource, ids: DataFrame | None = None) -> dict[int, DataFrame]:
    """Documents of every version, which a build writes side by side."""
    return {v.number: documents(config, sources, resource.type, v.number, ids) for v in resource.ascending}
