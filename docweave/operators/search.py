"""Searching one resource: validation, routed filters, text, order, pages and totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import Config, Version
from docweave.errors import InvalidArgument
from docweave.functions import predicates, text
from docweave.functions.predicates import Filter

#: Results that paging can reach, and page sizes.
WINDOW = 10_000
PAGE_SIZE, PAGE_CAP = 25, 100


@dataclass(frozen=True)
class Sort:
    field: str
    desc: bool = False


@dataclass(frozen=True)
class SearchRequest:
    resource: str
    query: str = ""
    page: int = 0
    page_size: int = 0
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()
    scope: str = ""
    scan: bool = False
    page_token: str = ""

    def with_filter(self, f: Filter) -> SearchRequest:
        return replace(self, filters=(*self.filters, f))


#: A handler takes a request and gives the hits before order and page; a middleware wraps a handler.
Handler = Callable[[SearchRequest], DataFrame]
Middleware = Callable[[Handler], Handler]


@dataclass
class SearchResult:
    """hits: id, score and the document, one page in order. total: a one-row DataFrame, counted over all pages."""

    hits: DataFrame
    matches: DataFrame

    @property
    def total(self) -> int:
        return self.matches.count()


@dataclass
class Searcher:
    """Searches over the documents that `read` gives for a type: those of its read version, behind its alias.

    read returns None where no index is behind the alias yet; then the result is empty. A ceiling is for callers who want
    references refused that match more children; without one, any number of them is joined.
    """

    config: Config
    read: Callable[[str], DataFrame | None]
    empty: Callable[[str], DataFrame]
    middlewares: tuple[Middleware, ...] = ()
    ceiling: int | None = None
    versions: dict[str, int] = field(default_factory=dict)  #: pinned by a scan

    def version(self, resource: str) -> Version:
        return self.config.resource(resource).version(self.versions.get(resource))

    def docs(self, resource: str) -> DataFrame:
        found = self.read(resource)
        return self.empty(resource) if found is None else found

    def matches(self, request: SearchRequest) -> DataFrame:
        """All hits with score: the request is checked first, then middlewares run, whose own filters aren't checked."""
        version = self.version(request.resource)
        predicates.check(version, list(request.filters))
        for s in request.sort:
            sort_column(version, s, self.docs(request.resource))
        handler: Handler = self._base
        for m in reversed(self.middlewares):
            handler = m(handler)
        return handler(request)

    def _base(self, request: SearchRequest) -> DataFrame:
        docs = self.filtered(request.resource, list(request.filters), request.scope)
        return text.scored(docs, request.query)

    def route(self, resource: str, filters: list[Filter]) -> tuple[list[Filter], dict[str, list[Filter]]]:
        """Filters on the documents themselves, and, for each reference, those on its child's root fields."""
        version = self.version(resource)
        own, routed = [], {}
        for f in filters:
            head, _, name = f.field.partition(".")
            relation = version.relation(head)
            if f.field and relation is not None and relation.reference:
                if not relation.field(name):
                    raise InvalidArgument(f"unknown filter field {f.field!r}")
                routed.setdefault(head, []).append(replace(f, field=f"fields.{name}", nested_path=""))
            else:
                own.append(f)
        return own, routed

    def filtered(self, resource: str, filters: list[Filter], scope: str = "") -> DataFrame:
        """Documents that pass all filters; those on references have become semi-joins."""
        version, docs = self.version(resource), self.docs(resource)
        own, routed = self.route(resource, filters)
        for test in predicates.all_of(own, version, docs.schema, scope):
            docs = docs.where(test)
        for name, child_filters in routed.items():
            docs = self._semi_join(docs, version, name, child_filters, scope)
        return docs

    def judged(self, resource: str, filters: list[Filter], scope: str = "") -> DataFrame:
        """All documents, with a column seen: whether they pass all filters. Only filters on references need a join."""
        own, routed = self.route(resource, filters)
        docs = self.docs(resource)
        if routed:
            kept = self.filtered(resource, filters, scope).select("id", F.lit(True).alias("seen"))
            return docs.join(kept, "id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
        tests = predicates.all_of(own, self.version(resource), docs.schema, scope)
        return docs.withColumn("seen", F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False)))

    def _semi_join(self, docs: DataFrame, version: Version, name: str, filters: list[Filter], scope: str) -> DataFrame:
        """Documents whose key is the join key of a child that passes all filters at once; the caller's scope goes along.

        All children take part, in one plan. Only where the searcher has a ceiling are they counted ahead of it, and more
        of them than that refused, however few keys they have.
        """
        relation = version.relation(name)
        child = self.filtered(name, filters, scope)
        foreign = relation.join.foreign
        if foreign == "id":
            key = F.col("id")
        else:
            if foreign not in child.schema["fields"].dataType.fieldNames():
                raise InvalidArgument(f"the reference to {name!r} joins on {foreign!r}, which isn't a field of it")
            key = F.col("fields")[foreign].cast("string")
        keys = child.select(key.alias("__key")).where(F.col("__key").isNotNull() & (F.col("__key") != "")).distinct()
        if self.ceiling is not None and child.count() > self.ceiling:
            raise InvalidArgument(f"filters on {name!r} match more than {self.ceiling} rows")
        join = relation.join
        if not join.source:
            local = F.col("id") if join.local == "id" else F.col("fields")[join.local].cast("string")
            return docs.join(keys, local == F.col("__key"), "left_semi")
        sibling = version.relation(join.source)
        value = F.col(sibling.resource)[join.local]
        if not sibling.many:
            return docs.join(keys, value.cast("string") == F.col("__key"), "left_semi")
        linked = docs.select(F.col("id").alias("__id"), F.explode(value).alias("__local")).join(keys, F.col("__local").cast("string") == F.col("__key"), "left_semi").select("__id").distinct()
        return docs.join(linked, F.col("id") == F.col("__id"), "left_semi")

    def search(self, request: SearchRequest) -> SearchResult:
        size, offset = page_window(request.page, request.page_size)
        version = self.version(request.resource)
        matched = self.matches(request)
        order = sort_order(version, request.sort, matched)
        return SearchResult(matched.orderBy(*order).offset(offset).limit(size), matched)


def page_window(page: int, size: int) -> tuple[int, int]:
    """(size, offset): sizes below 1 are the default, those above the cap the cap, pages below 0 the first."""
    size = PAGE_SIZE if size <= 0 else min(size, PAGE_CAP)
    page = max(page, 0)
    if (page + 1) * size > WINDOW:
        raise InvalidArgument(f"page {page} of size {size} ends beyond result {WINDOW}")
    return size, page * size


def sort_column(version: Version, sort: Sort, docs: DataFrame) -> Column | None:
    """What a sort compares; None for a sort without a field, which is skipped."""
    if not sort.field:
        return None
    if sort.field in ("resource_id", "score"):
        return F.col("id") if sort.field == "resource_id" else F.col("score")
    found, reference = predicates.resolve(version, sort.field)
    head, _, name = sort.field.partition(".")
    if reference or found.type == "text":
        raise InvalidArgument(f"results can't be sorted by {sort.field!r}")
    value = F.col(head)[name]
    key = predicates.ip_key if found.family == "ip" else lambda c: c
    if docs.schema[head].dataType.typeName() == "array" or (head == "fields" and docs.schema[head].dataType[name].dataType.typeName() == "array"):
        # of several values the least counts upwards and the greatest downwards
        return (F.array_max if sort.desc else F.array_min)(F.transform(value, key))
    return key(value)


def sort_order(version: Version, sorts: tuple[Sort, ...], docs: DataFrame) -> list[Column]:
    """The caller's order, nulls last either way, or the score's; then the id, so that the order is total."""
    order = []
    for s in sorts:
        c = sort_column(version, s, docs)
        if c is not None:
            order.append(c.desc_nulls_last() if s.desc else c.asc_nulls_last())
    return (order or [F.col("score").desc()]) + [F.col("id").asc()]


def join_key(hits: DataFrame, foreign: str) -> Column:
    """The key by which hits are joined: their id, or one of their fields."""
    return F.col("id") if foreign == "id" else F.col("fields")[foreign].cast("string")
