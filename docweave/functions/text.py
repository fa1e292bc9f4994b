"""Text analysis and ranking with built-in functions: words, grams, clauses and BM25."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams; boosts of whole words over grams on either surface.
GRAMS = (2, 3)
PRIMARY_BOOSTS = (9.0, 3.0)
SECONDARY_BOOSTS = (3.0, 1.0)
K1, B = 1.2, 0.75

_SPLIT = r"[^\p{L}\p{N}]+"


def words(texts: Column) -> Column:
    """Words of an array of texts, in order with repeats: lower case, runs of letters and digits."""
    return F.flatten(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.filter(F.split(F.lower(t), _SPLIT), lambda w: w != "")))


def grams(tokens: Column) -> Column:
    """Grams of 2 and 3 characters of an array of words, with repeats; none goes over a word's ends."""

    none = F.array().cast("array<string>")

    def of_length(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1)))
        return F.when(F.length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(none)

    def of_word(w: Column) -> Column:
        return F.concat(*[of_length(w, n) for n in GRAMS])

    return F.flatten(F.transform(tokens, of_word))


def query_words(query: str) -> list[str]:
    """The distinct words of a query, analysed like texts."""
    return list(dict.fromkeys(w for w in re.split(r"[^\w]|_", query.lower()) if w))


def query_grams(query: str) -> list[str]:
    return list(dict.fromkeys(w[i : i + n] for w in query_words(query) for n in GRAMS for i in range(len(w) - n + 1)))


# Searching works on the surface as one string of lower-case words with two spaces between and one at either end. A gram is a
# substring then (it has no space, so it never goes over a word's end), a word is one with its two spaces, and both are
# counted by what replacing them takes away. No token array is made.

_SEPARATORS = r"[^\p{L}\p{N}]+"


def surface(texts: Column) -> Column:
    """An array of texts as one string of its words."""
    joined = F.lower(F.coalesce(F.array_join(texts, "\n"), F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(joined, _SEPARATORS, "  ")), F.lit(" "))


def _letters(t: Column) -> Column:
    return F.length(F.replace(t, F.lit(" "), F.lit("")))


def word_total(t: Column) -> Column:
    """How many words a surface has."""
    return F.when(t != "  ", (F.length(t) - _letters(t)) / 2).otherwise(0.0)


def gram_total(t: Column) -> Column:
    """How many grams it has: n - 1 and n - 2 for a word of n > 1 characters."""
    return 2.0 * _letters(t) - 3.0 * word_total(t) + F.regexp_count(t, F.lit(" [^ ] "))


def has_word(t: Column, word: str) -> Column:
    return t.contains(f" {word} ")


def _occurrences(t: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)


def count_word(t: Column, word: str) -> Column:
    return F.when(has_word(t, word), _occurrences(t, f" {word} ")).otherwise(0.0)


def count_gram(t: Column, gram: str) -> Column:
    """How often a gram is there; only one that ends as it begins can overlap itself."""
    found = _occurrences(t, gram) if gram[0] != gram[-1] else F.regexp_count(t, F.lit(f"(?={gram})")).cast("double")
    return F.when(t.contains(gram), found).otherwise(0.0)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _short(query: str) -> list[str]:
    """Query words that are grams themselves."""
    return [w for w in query_words(query) if len(w) in GRAMS]


def whole_word(t: Column, query: str) -> Column:
    """Any query word is a word of the text, or is itself one of its grams."""
    return _any([has_word(t, w) for w in query_words(query) if len(w) not in GRAMS] + [t.contains(w) for w in _short(query)])


def infix(t: Column, query: str) -> Column:
    """All grams of the query are there; a query without grams matches nothing."""
    q = query_grams(query)
    return reduce(lambda a, b: a & b, [t.contains(g) for g in q]) if q else F.lit(False)


def matches(t: Column, query: str) -> Column:
    """A surface matches by a whole word or as a substring (of which all grams must be there)."""
    return whole_word(t, query) | infix(t, query)


def entry_matches(e: Column, query: str, scope: str = "") -> Column:
    """A secondary entry matches and, where a scope is given, belongs to it."""
    test = matches(surface(e["text"]), query)
    return test & F.coalesce(F.array_contains(e["scope"], scope), F.lit(False)) if scope else test


def _stats(name: str, t: Column, qw: list[str], qg: list[str]) -> list[Column]:
    """Aggregates over documents: mean lengths in words and grams, and in how many of them each term is."""
    return [
        F.avg(word_total(t)).alias(f"mean_{name}w"), F.avg(gram_total(t)).alias(f"mean_{name}g"),
        F.array(*[F.count_if(has_word(t, w)).cast("double") for w in qw]).alias(f"df_{name}w"),
        (F.array(*[F.count_if(t.contains(g)).cast("double") for g in qg]) if qg else F.array().cast("array<double>")).alias(f"df_{name}g"),
    ]


def _bm25(counts: Column, size: Column, mean: Column, n: Column, df: Column) -> Column:
    """Sum over the terms of idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), Robertson and Zaragoza 2009."""
    norm = K1 * (1 - B + B * size / F.greatest(mean, F.lit(1e-9)))
    part = lambda tf, have: F.when(tf > 0, F.log(1 + (n - have + 0.5) / (have + 0.5)) * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    return F.aggregate(F.zip_with(counts, df, part), F.lit(0.0), lambda a, x: a + x)


def _counts(t: Column, query: str) -> Column:
    """What scoring needs of a surface: its lengths, and how often each query word and gram is there."""
    qw, qg = query_words(query), query_grams(query)
    grams_ = F.array(*[count_gram(t, g) for g in qg]) if qg else F.array().cast("array<double>")
    return F.struct(word_total(t).alias("words"), gram_total(t).alias("grams"), F.array(*[count_word(t, w) for w in qw]).alias("w"), grams_.alias("g"))


def _clauses(c: Column, name: str, query: str, boosts: tuple[float, float]) -> Column:
    """The better of whole words and of words that are grams, and the query's grams if all are there (c: see _counts)."""
    qg = query_grams(query)
    short = [i for i, g in enumerate(qg) if g in _short(query)]
    pick = lambda array: F.array(*[array[i] for i in short]) if short else F.array().cast("array<double>")
    n, mean_g, df_g = F.col("n"), F.col(f"mean_{name}g"), F.col(f"df_{name}g")
    by_words = _bm25(c["w"], c["words"], F.col(f"mean_{name}w"), n, F.col(f"df_{name}w"))
    by_short = _bm25(pick(c["g"]), c["grams"], mean_g, n, pick(df_g))
    by_grams = F.when(F.forall(c["g"], lambda x: x > 0), _bm25(c["g"], c["grams"], mean_g, n, df_g)).otherwise(0.0) if qg else F.lit(0.0)
    return F.greatest(boosts[0] * by_words, boosts[1] * by_short) + by_grams


def scored(docs: DataFrame, query: str, secondary: bool = False, scope: str = "", local: list[str] | None = None, digits: int = 6) -> DataFrame:
    """The documents that match, with their score.

    docs has search_primary and, for the federated form, search_secondary. The score sums what matches: the better of
    whole words (boost 9) and of words that are grams (boost 3) on the primary surface, the query's grams if all are
    there (no boost), and the same on secondary entries with boosts 3 and 1, averaged over the entries that match.
    Statistics are taken over all of docs, or over each value of the columns `local`, before anything is filtered out.
    An empty query matches all documents with score 0.
    """
    if not query.strip():
        return docs.withColumn("score", F.lit(0.0))
    qw, qg = query_words(query), query_grams(query)
    if not qw:
        return docs.withColumn("score", F.lit(0.0)).where(F.lit(False))
    by, columns = local or ["__all"], docs.columns
    docs = docs.withColumn("__t", surface(F.col("search_primary")))
    if not local:
        docs = docs.withColumn("__all", F.lit(0))
    aggs = [F.count(F.lit(1)).alias("n"), *_stats("p", F.col("__t"), qw, qg)]
    if secondary:
        # all entries of a document are one text for statistics
        whole = surface(F.flatten(F.transform(F.col("search_secondary"), lambda e: e["text"])))
        docs = docs.withColumn("__s", whole)
        aggs += _stats("s", F.col("__s"), qw, qg)
    # one row, or one for each searched type: both are settled by the request, not by the data
    stats = F.broadcast(docs.groupBy(*by).agg(*aggs))
    hit = matches(F.col("__t"), query)
    entries = F.filter(F.col("search_secondary"), lambda e: entry_matches(e, query, scope)) if secondary else None
    if secondary:
        docs = docs.withColumn("__e", F.when(matches(F.col("__s"), query), entries))
        any_entry = F.coalesce(F.size("__e"), F.lit(-1)) > 0
    else:
        any_entry = F.lit(False)
    met = docs.withColumn("__p", hit).where(F.col("__p") | any_entry).withColumn("__c", _counts(F.col("__t"), query)).join(stats, by)
    score = F.when(F.col("__p"), _clauses(F.col("__c"), "p", query, PRIMARY_BOOSTS)).otherwise(0.0)
    if secondary:
        met = met.withColumn("__e", F.transform("__e", lambda e: _counts(surface(e["text"]), query)))
        each = F.transform("__e", lambda c: _clauses(c, "s", query, SECONDARY_BOOSTS))
        score = score + F.when(F.coalesce(F.size("__e"), F.lit(-1)) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size("__e")).otherwise(0.0)
    return met.withColumn("score", F.round(score, digits)).select(*columns, "score")
