"""One ranked result list over several resource types, with a count for each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.errors import InvalidArgument
from docweave.functions import predicates, text
from docweave.functions.predicates import Filter
from docweave.operators.search import Searcher, page_window

#: How statistics for scores are taken and results merged: over all types, over each, or each type searched by itself.
MODES = ("single-dfs", "single", "fanout")


@dataclass(frozen=True)
class FederatedRequest:
    query: str
    resources: tuple[str, ...]
    filters: tuple[Filter, ...] = ()
    page: int = 0
    page_size: int = 0
    include_source: bool = False
    resource_filters: dict[str, tuple[Filter, ...]] = field(default_factory=dict)
    secondary_scope: str = ""
    scope: str = ""
    mode: str = "single-dfs"


@dataclass
class FederatedResult:
    """hits: resource, id, score (and source); counts: resource, n for every requested type, in request order."""

    hits: DataFrame
    counts: DataFrame
    matches: DataFrame

    @property
    def total(self) -> int:
        return self.matches.count()


def index_alias(resource: str) -> str:
    return f"{resource}_search"


def check(searcher: Searcher, request: FederatedRequest) -> None:
    if request.mode not in ("", *MODES):
        raise InvalidArgument(f"unknown mode {request.mode!r}")
    if not request.resources:
        raise InvalidArgument("at least one resource type is required")
    if len(set(request.resources)) != len(request.resources):
        raise InvalidArgument("a resource type is requested twice")
    for name in request.resources:
        version = searcher.version(name)
        for f in request.filters:
            if f.field and not f.field.startswith("fields."):
                raise InvalidArgument(f"a filter for all types must be on fields.*, not {f.field!r}")
        predicates.check(version, list(request.filters))


def legs(searcher: Searcher, request: FederatedRequest) -> DataFrame:
    """The documents of all types that may be seen: each type's own filters and scoped blocks hold for it alone."""
    parts = []
    for name in request.resources:
        own = [*request.filters, *request.resource_filters.get(name, ())]
        docs = searcher.judged(name, own, request.scope)
        source = [F.to_json(F.struct("fields")).alias("source")] if request.include_source else []
        parts.append(docs.select(F.lit(name).alias("resource"), F.lit(index_alias(name)).alias("index"), "id", "search_primary", "search_secondary", "seen", *source))
    return reduce(DataFrame.unionByName, parts)


def federated_search(searcher: Searcher, request: FederatedRequest) -> FederatedResult:
    """Hits over all requested types: score, then index, then id; membership, counts and totals are the same in every mode.

    Scores use statistics of whole indices (filters don't change them). A type whose filters or empty scope match
    nothing keeps a count of 0. Modes differ only in the scope of statistics: all types together, or each by itself.
    """
    check(searcher, request)
    size, offset = page_window(request.page, request.page_size)
    mode = request.mode or MODES[0]
    docs = legs(searcher, request)
    scored = text.scored(docs, request.query, secondary=True, scope=request.secondary_scope, local=None if mode == MODES[0] else ["resource"])
    matched = scored.where("seen").drop("seen")
    order = [F.col("score").desc(), F.col("index"), F.col("id")]
    if mode == "fanout":
        # every type gives the whole window, then the merged order is cut
        parts = [matched.where(F.col("resource") == r).orderBy(*order).limit(size + offset) for r in request.resources]
        merged = reduce(DataFrame.unionByName, parts)
    else:
        merged = matched
    columns = ["resource", "id", "score"] + (["source"] if request.include_source else [])
    hits = merged.orderBy(*order).offset(offset).limit(size).select(*columns)
    wanted = matched.sparkSession.createDataFrame([(i, r) for i, r in enumerate(request.resources)], "ord int, resource string")
    counts = wanted.join(matched.groupBy("resource").agg(F.count(F.lit(1)).alias("n")), "resource", "left")
    return FederatedResult(hits, counts.select("ord", "resource", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ord").drop("ord"), matched)
