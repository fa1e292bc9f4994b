"""Operator 7: toxicity scores by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import blocks, table, with_text, written

#: Labelled documents that a model is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Words of the learned lexicon, at most; documents of label 1 that must hold one; standard errors above even odds.
LEXICON, SUPPORT, CERTAIN = 256, 3, 4.0
THRESHOLD = 0.7
NEAR = 5
BLOCK = 4 << 20

#: A general list of insults, in the four languages of the tables, without words that mean something harmless in another
#: of them; the rest is learned.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish loser losers trash garbage scum
pathetic worthless useless disgusting clown clowns creep freak retard imbecile lunatic coward liar filthy vermin parasite
crap bastard bitch asshole shit fuck fucking damn
idiota imbécil estúpido estúpida basura asqueroso asquerosa payaso perdedor patético mierda cabrón
imbécile débile stupide crétin ordure merde connard salaud pathétique dégoûtant
idiotisch dummkopf trottel abschaum versager erbärmlich wertlos nutzlos ekelhaft widerlich arschloch scheiße
""".split()
SECOND_PERSON = "you your yours yourself youre ur u tu te toi vous votre vos ton du dich dir dein deine ihr euch usted ustedes tú ti su".split()

_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SHOUT = b"!?"
_SPACE = b" \t\n\r\v\f"
_MASKS = b"0123456789$@!*_|+#%&"
#: What a byte is, for finding masked words: a letter, a mask, white space or a dot, or other.
_KIND = bytes(97 if c in _LETTERS else 49 if c in _MASKS else 32 if c in _SPACE else 46 for c in range(256))
#: What masks commonly stand for.
_UNMASK = bytes.maketrans(b"01345789$@!|+", b"oieastbgsaiit")

FEATURES = (
    "log_words", "insults_per_word", "learned_per_word", "log_insults", "log_learned", "weight_sum", "weight_most", "masked_per_word",
    "unmasked_hits", "near_second_person", "second_person_per_word", "upper_share", "shout_share", "punctuation_share", "digit_share",
    "masks_per_word", "words_repeated",
)


@dataclass
class Lexicon:
    learned: dict[bytes, float] = field(default_factory=dict)
    insults: frozenset = frozenset(w.encode() for w in INSULTS)
    second: frozenset = frozenset(w.encode() for w in SECOND_PERSON)

    def __post_init__(self):
        self.all = self.insults | set(self.learned)


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_WORDS).split()


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; all are 0 for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = words_of(data)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    hits = [i for i, w in enumerate(words) if w in lexicon.all]
    insults = sum(words[i] in lexicon.insults for i in hits)
    weights = [lexicon.learned[words[i]] for i in hits if words[i] in lexicon.learned]
    kinds = data.translate(_KIND)
    masked = sum(kinds.count(x) for x in (b"a1a", b"a11a", b"a.a.a"))
    unmasked = 0
    if masked or b"1a" in kinds:
        for w in data.lower().split():
            kind = w.translate(_KIND)
            if b"1a" in kind or b"a.a.a" in kind:
                plain = w.translate(_UNMASK).translate(None, b".*_-#%&,;:\"'()")
                unmasked += plain in lexicon.all
    near = 0
    second = [i for i, w in enumerate(words) if w in lexicon.second]
    if hits and second:
        at = np.searchsorted(second, hits)
        pad = np.array([-(1 << 40), *second, 1 << 40])
        gap = np.minimum(np.array(hits) - pad[at], pad[at + 1] - np.array(hits))
        near = int((gap <= NEAR).sum())
    size = len(data)
    share = lambda chars: (size - len(data.translate(None, chars))) / size
    letters = share(_LETTERS)
    return [
        math.log1p(n), insults / n, len(weights) / n, math.log1p(insults), math.log1p(len(weights)), sum(weights), max(weights, default=0.0),
        masked / n, float(unmasked), near / len(hits) if hits else 0.0, len(second) / n, share(_UPPER) / letters if letters else 0.0,
        share(_SHOUT), share(_PUNCTUATION), share(_DIGITS), sum(kinds.count(x) for x in (b"a1 ", b" 1a")) / n, 1 - len(set(words)) / n,
    ]


class Trees:
    """Gradient boosting of logistic loss: trees of a fixed depth over binned features, grown level by level."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        binned = self._binned(x)
        flat = binned + np.arange(k) * self.bins
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw, self.trees = np.full(n, self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node, splits = np.zeros(n, np.int64), []
            for level in range(self.depth):
                width = 1 << level
                at = (node[:, None] * (k * self.bins) + flat).ravel()
                shape = (width, k, self.bins)
                gs = np.bincount(at, np.repeat(g, k), width * k * self.bins).reshape(shape).cumsum(axis=2)
                hs = np.bincount(at, np.repeat(h, k), width * k * self.bins).reshape(shape).cumsum(axis=2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                score = lambda a, b: a * a / (b + self.ridge)
                gain = score(gs, hs) + score(gt - gs, ht - hs) - score(gt, ht)
                gain[(hs < self.least * 0.1) | (ht - hs < self.least * 0.1)] = 0.0
                best = gain.reshape(width, -1).argmax(axis=1)
                feature, cut = best // self.bins, best % self.bins
                cut = np.where(gain.reshape(width, -1).max(axis=1) > 1e-9, cut, self.bins)  # no gain: all go left
                splits.append((feature, cut))
                node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((splits, value))
            raw += value[node]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for splits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += value[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising step function of raw that is nearest to y: pools of adjacent violators, by their mean."""
    order = np.argsort(raw, kind="stable")
    xs, first = np.unique(raw[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    counts = np.diff(np.append(first, len(raw)))
    pools: list[list[float]] = []
    for x, s, c in zip(xs.tolist(), sums.tolist(), counts.tolist()):
        pools.append([x, x, s, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, s1, c1 = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s1, pools[-1][3] + c1]
    points = [(x, s / c) for a, b, s, c in pools for x in ((a, b) if a != b else (a,))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    heights: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.heights), 0.0, 1.0)


def fold(modulus: int):
    """crc32 of the doc_id as text, modulo; a null doc_id counts as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, half of at most `sample` labelled documents outside the held-out third, by hash of doc_id.

    Of rows that share a doc_id the least text counts, of their labels the greatest.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").alias("toxic")).where(fold(3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a line for each of at most `sample` rows: its size is bounded
    joined = held.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return joined.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int").alias("half"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic, half -> for each word in how many texts of either half it is, by label: n00, n01, n10, n11."""
    for batch in (part for whole in batches for part in blocks(whole, 0, BLOCK)):
        seen = [Counter() for _ in range(4)]
        for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
            seen[2 * half + toxic].update(set(words_of((text or "").encode("utf-8", "surrogatepass"))))
        words = list(set().union(*seen))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([s[w] for w in words], pa.int64()) for s in seen)], ["word", "n00", "n01", "n10", "n11"])


def learn_lexicons(rows: DataFrame, limit: int = LEXICON) -> list[dict[bytes, float]]:
    """Words that label 1 favours, with the logarithm of the odds, by the rows of half 0, of half 1, and of both.

    The `limit` surest ones of each come to the driver. Without rows of both labels there are none.
    """
    totals = {(r[0], r[1]): r[2] for r in rows.groupBy("half", "toxic").count().collect()}
    sums = [F.sum(n).alias(n) for n in ("n00", "n01", "n10", "n11")]
    counts = written(rows.select("text", "toxic", "half").mapInArrow(_word_counts, "word binary, n00 long, n01 long, n10 long, n11 long").groupBy("word").agg(*sums), "toxicity-words")
    found = []
    for halves in ((0,), (1,), (0, 1)):
        n0, n1 = (sum(totals.get((h, toxic), 0) for h in halves) for toxic in (0, 1))
        if not n0 or not n1:
            found.append({})
            continue
        held = [sum((F.col(f"n{h}{toxic}") for h in halves), F.lit(0)) for toxic in (0, 1)]
        a, b = held[1] + 0.5, held[0] + 0.5
        c, d = F.lit(n1 + 1) - a, F.lit(n0 + 1) - b
        odds = F.log(a * d / (b * c))
        sure = odds / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        best = counts.where((held[1] >= SUPPORT) & (held[1] < n1 + 0.5)).select("word", odds.alias("odds"), sure.alias("sure"))
        found.append({bytes(r[0]): float(r[1]) for r in best.where(F.col("sure") > CERTAIN).orderBy(F.desc("sure"), "word").limit(limit).collect()})
    return found


def _feature_rows(lexicons: list[Lexicon]):
    """Features of every text by each lexicon, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, 0, BLOCK)):
            x = [[v for lexicon in lexicons for v in features(t, lexicon)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "half"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model of labels.toxic from at most `sample` labelled documents, none of them held out.

    Trees fitted on either half, with the lexicon of that half alone, score the other half, whose labels neither has
    seen; the calibration is fitted on those scores, the final lexicon and trees on both halves. Without rows of both
    labels every score is the share of label 1 (0 without labels).
    """
    rows = written(training_rows(docs, labels, sample), "toxicity-sample")
    lexicons = [Lexicon(words) for words in learn_lexicons(rows)]
    found = rows.mapInArrow(_feature_rows(lexicons), "x array<double>, toxic int, half int").collect()
    found.sort(key=lambda r: (r[2], r[1], r[0]))  # the same fit whatever the order of arrival
    y = np.array([r[1] for r in found], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(lexicons[2], None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    x, half = np.array([r[0] for r in found]).reshape(len(y), 3, -1), np.array([r[2] for r in found])
    out = np.zeros(len(y))
    for k in (0, 1):
        own, other = half == k, half != k
        if not own.any():
            continue
        if y[other].min(initial=1) == y[other].max(initial=0):  # too few rows to keep the halves apart
            out[own] = Trees().fit(x[:, 2], y).raw(x[own, 2])
        else:
            out[own] = Trees().fit(x[other, 1 - k], y[other]).raw(x[own, 1 - k])
    knots, heights = isotonic(out, y)
    return ToxicityModel(lexicons[2], Trees().fit(x[:, 2], y), knots, heights, float(y.mean()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the columns to keep, and score.

    Only the text is looked at; null, empty and blank texts are scored by features that are all 0. Null and repeated
    doc_ids are kept. An empty table gives an empty result. Nothing is shuffled; the model's size is bounded by the
    number of trees and of learned words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, at = with_text(docs, keep, [])
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keep)]), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (part for whole in batches for part in blocks(whole, at, BLOCK)):
            x = np.array([features(t, own.lexicon) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own.scores(x), pa.float64())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def op7_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))).withColumn("doc_id", F.col("doc_id").cast("long"))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
