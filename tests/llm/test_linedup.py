from __future__ import annotations

import random
import re

from docweave.llm import linedup as d
from tests.llm.conftest import docs_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line: str) -> str:
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOW)


def brute(rows) -> dict:
    held: dict = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i if i is not None else -(1 << 63))
    gone = {k: max(x) for k, x in held.items() if len(x) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if key(x) not in gone or gone[key(x)] == (i if i is not None else -(1 << 63))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    lines = ["A line that is long enough %d" % i for i in range(12)] + ["short", "", "  ", "ÀÉ line of twenty code points é", "x" * 20, "x" * 19]
    vary = [lambda x: x, str.upper, lambda x: "\t " + x, lambda x: x + " \r\f"]
    rows = [(i, "\n".join(rng.choice(vary)(rng.choice(lines)) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    assert sorted((tuple(r) for r in d.dedup_lines(docs).collect()), key=str) == brute(rows)


def test_runs_do_not_depend_on_batches(spark):
    rows = [(i, f"the line that all share, number {i % 4}\nown line of document {i} only") for i in range(60)]
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in rows])
    for batches, fanout in ((1, 2), (7, 2), (5, 4)):
        found = sorted((tuple(r) for r in d.dedup_lines(docs, batches=batches, fanout=fanout).collect()), key=str)
        assert found == brute(rows)


def test_levels_and_fresh_lines(spark):
    runs = d.LineRuns(spark, fanout=2)
    docs = [docs_of(spark, [(i, f"line number {i} is long enough\nline number {i + 1} is long enough", "en", "s")]) for i in range(5)]
    fresh = [runs.add(d.keyed_lines(x)).count() for x in docs]
    assert fresh == [2, 1, 1, 1, 1]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r["docs"] for r in runs.rows().collect()) == [1, 1, 2, 2, 2, 2]


def test_odd_rows(odd, none):
    found = [tuple(r) for r in d.dedup_lines(odd).collect()]
    assert len(found) == odd.count()
    by = {r[0]: r for r in found}
    assert by[1] == (1, 1, 0, "") and by[2] == (2, 1, 0, "") and by[3] == (3, 2, 0, " \t\n ")
    # rows of one id are one document: two ids hold the line, which isn't enough
    assert by[4][2] == by[5][2] == 0
    assert d.dedup_lines(none).count() == 0


def test_null_id_counts_as_smallest(spark):
    line = "a line that three documents hold"
    found = {r[0]: r[2] for r in d.dedup_lines(docs_of(spark, [(None, line, "en", "s"), (1, line, "en", "s"), (2, line, "en", "s")])).collect()}
    assert found == {None: 1, 1: 1, 2: 0}
