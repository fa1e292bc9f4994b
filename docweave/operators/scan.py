"""Scans: every match once, page by page, from one snapshot of one index."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import CursorExpired, InvalidArgument, InvalidPageToken, ScanFault
from docweave.operators.search import Searcher, SearchRequest, sort_column
from docweave.sources import files
from docweave.sources.store import DocumentStore, parse_index

#: Hits of a page by default and at most, how long a scan can be continued, and hits in a file of them.
SCAN_PAGE = 1000
MAX_AGE = 3600.0
FILE_HITS = 100_000


@dataclass
class ScanPage:
    hits: DataFrame
    next_token: str
    total: int | None  #: told by the first page


def fingerprint(request: SearchRequest) -> str:
    """A digest of all that decides a scan's hits; every part goes with its length, so that no two requests look alike."""
    parts = [request.resource, request.query, request.scope, str(len(request.filters))]
    for f in request.filters:
        parts += [f.field, f.op, f.value, f.nested_path, str(len(f.values)), *f.values]
    parts.append(str(len(request.sort)))
    for s in request.sort:
        parts += [s.field, "desc" if s.desc else "asc"]
    whole = b"".join(b"%d:%s" % (len(p.encode()), p.encode()) for p in parts)
    return hashlib.sha256(whole).hexdigest()


def encode_token(content: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(content, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_token(token: str) -> dict:
    try:
        content = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        if set(content) != {"start", "version", "index", "fingerprint", "segments", "hits", "plan", "at"} or not re.fullmatch(r"\d+-[0-9a-f]{32}", content["hits"]):
            raise ValueError(token)
    except ValueError as e:
        raise InvalidPageToken("the page token can't be read") from e
    return content


def after(keys: list[tuple[Column, bool]], cursor: list) -> Column:
    """Rows strictly after the cursor in an order of (column, descending) with nulls last either way.

    A row comes after if, at the first key where it differs, its value does; null is after everything and equal to null.
    """
    cases, same = [], F.lit(True)
    for (c, desc), value in zip(keys, cursor):
        v = F.lit(value)
        if value is not None:
            later = F.coalesce(c < v if desc else c > v, F.lit(True))
            cases.append(same & later)
        same = same & c.eqNullSafe(v)
    return reduce(lambda a, b: a | b, cases, F.lit(False))


@dataclass
class Scanner:
    """Scans a store through a searcher's checks, filters and middlewares; clock gives seconds.

    The first page writes all hits once, in their order, beside the store; a page is then a slice of one or a few of these
    files. Hits that no token can reach any more go when another scan begins.
    """

    searcher: Searcher
    store: DocumentStore
    max_age: float = MAX_AGE
    clock: Callable[[], float] = time.time

    def _pin(self, resource: str) -> tuple[int, str, list[str]] | None:
        targets = self.store.alias(resource)
        if not targets:
            return None
        parsed = parse_index(targets[0]) if len(targets) == 1 else None
        known = {v.number for v in self.searcher.config.resource(resource).versions}
        if parsed is None or parsed[0] != resource or parsed[1] not in known:
            raise ScanFault(f"the alias of {resource!r} leads to {targets}, not to one index of a configured version")
        return parsed[1], targets[0], self.store.log(*parsed).manifest()["segments"]

    def page(self, request: SearchRequest) -> ScanPage:
        """A page of at most SCAN_PAGE hits in the request's order, the id last, and the token of the next one.

        The first page pins the index and its segments; later ones read the same, whatever has been written since, as
        long as the token is no older than max_age. Checks and middlewares run for every page; where they come to another
        plan than the one whose hits were written, what follows the last page is written anew. A page that isn't full is
        the last. No alias: an empty scan.
        """
        if request.page:
            raise InvalidArgument("a scan has no page number")
        size = SCAN_PAGE if request.page_size <= 0 else min(request.page_size, SCAN_PAGE)
        self.searcher.config.resource(request.resource)
        print_ = fingerprint(request)
        written = None
        if request.page_token:
            token = decode_token(request.page_token)
            if token["fingerprint"] != print_:
                raise InvalidPageToken("the page token belongs to another request")
            if self.clock() - token["start"] > self.max_age:
                raise CursorExpired(f"the scan was started more than {self.max_age:g} seconds ago")
            start, version, index, segments, written, plan, at = (token[k] for k in ("start", "version", "index", "segments", "hits", "plan", "at"))
        else:
            pinned = self._pin(request.resource)
            if pinned is None:
                return ScanPage(self.searcher.empty(request.resource).select("id"), "", 0)
            start, (version, index, segments) = self.clock(), pinned
        parsed = parse_index(index)
        pinned_docs = self.store.documents(*parsed, segments=segments)
        if pinned_docs is None:
            raise CursorExpired("the scan's snapshot is gone")
        read = self.searcher.read
        own = Searcher(
            self.searcher.config, lambda r: pinned_docs if r == request.resource else read(r), self.searcher.empty, self.searcher.middlewares, self.searcher.ceiling, {**self.searcher.versions, request.resource: version}
        )
        matched = own.matches(request)
        vc = own.version(request.resource)
        keys = [(c, s.desc) for s in request.sort if (c := sort_column(vc, s, matched)) is not None] or [(F.col("score"), True)]
        keys.append((F.col("id"), False))
        same = matched.semanticHash()
        if written is None:
            written, plan, at = self._write(matched, keys, start), same, 0
        elif plan != same:
            last = self._slice(written, at - 1, 1)[0].first()
            cursor = [last[f"__k{i}"] for i in range(len(keys))]
            written, plan, at = self._write(matched.where(after(keys, cursor)), keys, start), same, 0
        hits, total = self._slice(written, at, size)
        first = None if request.page_token else total
        if at + size > total:
            return ScanPage(hits.select("id", "score"), "", first)
        token = {"start": start, "version": version, "index": index, "fingerprint": print_, "segments": segments, "hits": written, "plan": plan, "at": at + size}
        return ScanPage(hits.select("id", "score"), encode_token(token), first)

    def _write(self, rows: DataFrame, keys: list[tuple[Column, bool]], start: float) -> str:
        """Writes hits with their sort keys in one order, and a list of the files with the first row's number and how many rows they hold."""
        spark, base = self.store.spark, f"{self.store.root}/scans"
        for old in files.listing(spark, base):
            if self.clock() - int(old.split("-")[0]) / 1000 > 2 * self.max_age:
                files.remove(spark, f"{base}/{old}")
        names = [f"__k{i}" for i in range(len(keys))]
        order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for (_, d), n in zip(keys, names)]
        found = rows.select("id", "score", *[c.alias(n) for (c, _), n in zip(keys, names)]).orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
        name = f"{int(start * 1000)}-{uuid.uuid4().hex}"
        found.write.option("maxRecordsPerFile", FILE_HITS).parquet(f"{base}/{name}/hits")
        parts = spark.read.schema(found.schema).parquet(f"{base}/{name}/hits").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a row for each file
        files.write_json(spark, f"{base}/{name}/files.json", {"schema": json.loads(found.schema.json()), "files": sorted((r["first"], r["n"], r["file"]) for r in parts)})
        return name

    def _slice(self, name: str, at: int, size: int) -> tuple[DataFrame, int]:
        """Hits at to at + size of those written, in their order, and how many there are. Numbers in a file go up by one."""
        spark, path = self.store.spark, f"{self.store.root}/scans/{name}"
        held = files.read_json(spark, f"{path}/files.json", None)
        if held is None:
            raise CursorExpired("the scan's hits are gone")
        schema, before, wanted, tests = T.StructType.fromJson(held["schema"]), 0, [], [F.lit(False)]
        for first, n, file in held["files"]:
            low, high = max(at, before), min(at + size, before + n)
            if low < high:
                wanted.append(f"{path}/hits/{file}")
                tests.append(F.col("__at").between(first + low - before, first + high - before - 1))
            before += n
        rows = spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)
        return rows.where(reduce(lambda a, b: a | b, tests)).coalesce(1).sortWithinPartitions("__at"), before
