"""Scans write their hits once; pages read slices of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.config import load
from docweave.errors import CursorExpired
from docweave.functions.predicates import Filter
from docweave.operators import scan
from docweave.operators.scan import Scanner
from docweave.operators.search import Searcher, SearchRequest, Sort
from docweave.plans.denorm import documents
from docweave.plans.schema import document_schema
from docweave.sources import files
from docweave.sources.registry import Sources
from docweave.sources.store import DocumentStore, index_name

CONFIG = load("resources:\n  - type: part\n    fields: [{name: name, query: {search: primary}}, {name: size, type: integer}]\n")
REQUEST = {"filters": (Filter("fields.size", "lt", "40"),), "sort": (Sort("fields.size", True),), "page_size": 50}
WANT = sorted((str(i) for i in range(300) if i % 50 < 40), key=lambda x: (-(int(x) % 50), x))


@pytest.fixture
def store(spark, tmp_path):
    s, found = Sources(spark), DocumentStore(spark, f"file://{tmp_path}/store")
    s.add("part", spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("name"), (F.col("id") % 50).cast("int").alias("size")))
    found.upsert("part", 1, documents(CONFIG, s, "part").drop("found"), 1)
    found.point("part", index_name("part", 1))
    return found


def scanner(spark, store, *middlewares, now=(0.0,)):
    empty = lambda r: spark.createDataFrame([], document_schema(CONFIG.resource(r).version())).withColumn("id", F.col("resource_id"))
    return Scanner(Searcher(CONFIG, store.read, empty, middlewares), store, clock=lambda: now[0])


def pages(found, **request):
    token = ""
    while True:
        page = found.page(SearchRequest("part", page_token=token, **{**REQUEST, **request}))
        yield [r["id"] for r in page.hits.collect()], page.total
        token = page.next_token
        if not token:
            return


def test_later_pages_shuffle_nothing(spark, store):
    found, context = scanner(spark, store), spark.sparkContext
    first = found.page(SearchRequest("part", **REQUEST))
    context.setJobGroup("later pages", "later pages")
    try:
        later = found.page(SearchRequest("part", page_token=first.next_token, **REQUEST))
        ids = [r["id"] for r in later.hits.collect()]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("later pages")]
    assert ids == WANT[50:100] and jobs and all(len(j.stageIds) == 1 for j in jobs)


def test_pages_cross_files_and_end_with_a_page_that_is_not_full(spark, store, monkeypatch):
    monkeypatch.setattr(scan, "FILE_HITS", 7)
    found = list(pages(scanner(spark, store)))
    assert [i for ids, _ in found for i in ids] == WANT and [total for _, total in found] == [240] + [None] * 4
    assert [len(ids) for ids, _ in pages(scanner(spark, store), page_size=80)] == [80, 80, 80, 0]
    assert len(files.listing(spark, f"{store.root}/scans")) == 2  # hits are written once a scan


def test_a_middleware_that_changes_holds_for_the_pages_that_follow(spark, store):
    bound = ["300"]

    def below(handler):
        return lambda request: handler(request.with_filter(Filter("fields.size", "lt", bound[0])))

    found = pages(scanner(spark, store, below))
    seen = [*next(found)[0], *next(found)[0]]
    bound[0] = "10"
    rest = [i for ids, _ in found for i in ids]
    assert seen == WANT[:100] and rest == [i for i in WANT if int(i) % 50 < 10]


def test_hits_of_old_scans_go(spark, store):
    now = [0.0]
    found = scanner(spark, store, now=now)
    token = found.page(SearchRequest("part", **REQUEST)).next_token
    now[0] = 7201.0
    found.page(SearchRequest("part", **REQUEST))
    assert len(files.listing(spark, f"{store.root}/scans")) == 1
    now[0] = 0.0
    with pytest.raises(CursorExpired):
        found.page(SearchRequest("part", page_token=token, **REQUEST))
