from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, size string, batch int, fp string, score string, `rank` string, `__id` string, `__drops` string, n string"


def docs_of(spark, rows, extra: bool = True):
    """documents with columns besides that have names like those that operators use inside."""
    full = [(i, t, lang, source, len(t) if t is not None else None, 1, "k", "s", 7, "f", "x", "r", "i", "d", "n") for i, t, lang, source in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


ODD = [
    (None, "a row without an id, of more than twenty characters", "en", None),
    (1, None, None, "s"),
    (2, "", "en", "s"),
    (3, " \t\n ", "en", ""),
    (4, "same text in two rows of one id", "en", "a"),
    (4, "same text in two rows of one id", "en", "a"),
    (5, "same text in two rows of one id", "de", "b"),
    (6, "word " * 40_000, "en", "a"),
    (7, "x" * 150_000, "en", "b"),
    (8, "12345 !!! ...", "en", "b"),
    (9, "ünïcödé ▁ marker 𝄞 \x00 zero", "fr", "é"),
]


@pytest.fixture()
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture()
def none(spark):
    return docs_of(spark, [])
