"""Operator 10: language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import blocks, table, written
from docweave.llm.toxicity import fold

#: Documents a model learns from, at most, as many of each language as can be, and bytes of their whole texts together.
SAMPLE, SAMPLE_BYTES = 800, 8 << 20
HIDDEN = 8
#: Bytes the network reads in one go, whatever words they belong to.
SPAN = 32
#: Parts of a language's documents that are numbered apart when the sample is drawn.
SALTS = 64
EPOCHS, BATCH, RATE = 3, 512, 0.012
SEED = 7
BLOCK = 2 << 20
ROWS = 2048
UNKNOWN = "und"

_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Cell:
    """One direction's gates, update, reset and candidate side by side: by byte (256, 3H), by state (H, 3H), and a bias."""

    byte: np.ndarray
    state: np.ndarray
    bias: np.ndarray

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (rows, steps, H) over bytes (rows, steps); keep gets what the way back needs."""
        n, steps = x.shape
        hid = self.state.shape[0]
        h, out = np.zeros((n, hid), self.state.dtype), np.empty((steps, n, hid), self.state.dtype)
        for t in range(steps):
            a, b = self.byte[x[:, t]], h @ self.state + self.bias
            gates = _sigmoid(a[:, : 2 * hid] + b[:, : 2 * hid])
            z, r = gates[:, :hid], gates[:, hid:]
            c = np.tanh(a[:, 2 * hid :] + r * b[:, 2 * hid :])
            if keep is not None:
                keep.append((h, z, r, c, b[:, 2 * hid :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def run(self, x: np.ndarray) -> np.ndarray:
        """What forward() gives, faster: gates side by side in memory, their halves of tanh folded into the weights."""
        n, steps = x.shape
        hid = self.state.shape[0]
        parts = [slice(0, hid), slice(hid, 2 * hid), slice(2 * hid, 3 * hid)]
        half = (self.byte + self.bias) * np.float32(0.5)
        byte_z, byte_r, byte_c = (np.ascontiguousarray(w[:, p]) for w, p in zip((half, half, self.byte), parts))
        state_z, state_r, state_c = (np.ascontiguousarray(self.state[:, p]) * np.float32(0.5) for p in parts)
        bias_c = self.bias[parts[2]] * np.float32(0.5)
        h, out = np.zeros((n, hid), self.state.dtype), np.empty((steps, n, hid), self.state.dtype)
        for t in range(steps):
            col = x[:, t]
            z, r, c, u = byte_z[col], byte_r[col], byte_c[col], h @ state_c
            z += h @ state_z
            r += h @ state_r
            u += bias_c
            np.tanh(z, out=z)
            np.tanh(r, out=r)
            r += 1  # twice the gate; u is half of what it opens for
            r *= u
            c += r
            np.tanh(c, out=c)
            z += 1
            z *= 0.5
            h = h - c
            h *= z
            h += c
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, grad: np.ndarray) -> Cell:
        """Backpropagation through time: gradients of byte, state and bias for grad (steps, rows, H) of the states."""
        out = Cell(np.zeros_like(self.byte), np.zeros_like(self.state), np.zeros_like(self.bias))
        back, of_bytes = np.zeros_like(grad[0]), []
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, c, u = kept[t]
            dh = grad[t] + back
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            da = np.concatenate((dz, dr, dc), axis=1)
            db = np.concatenate((dz, dr, dc * r), axis=1)
            of_bytes.append(da)
            out.state += h.T @ db
            out.bias += db.sum(axis=0)
            back = dh * z + db @ self.state.T
        order = np.argsort(x.T[::-1].ravel(), kind="stable")
        known, first = np.unique(x.T[::-1].ravel()[order], return_index=True)
        out.byte[known] = np.add.reduceat(np.concatenate(of_bytes)[order], first)
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Cell
    behind: Cell
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> LanguageModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        cell = lambda: Cell(draw(256, 3 * hidden, scale=0.3), draw(hidden, 3 * hidden, scale=hidden**-0.5), np.zeros(3 * hidden, np.float32))
        return cls(languages, cell(), cell(), draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def _parts(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.ahead.bias, self.behind.byte, self.behind.state, self.behind.bias, self.out, self.shift]

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every language at every position: (steps, rows, languages) for bytes (rows, steps)."""
        hid = self.ahead.state.shape[0]
        found = self.ahead.run(x) @ self.out[:hid]
        found += (self.behind.run(x[:, ::-1]) @ self.out[hid:])[::-1]
        return _softmax(found + self.shift)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions of spans (rows, steps) of languages y, and its gradients."""
        kept_a, kept_b = [], []
        ha = self.ahead.forward(x, kept_a)
        hb = self.behind.forward(x[:, ::-1], kept_b)[::-1]
        both = np.concatenate((ha, hb), axis=2)
        p = _softmax(both @ self.out + self.shift)
        n = x.size
        loss = float(-np.log(p[:, np.arange(len(y)), y] + 1e-12).sum() / n)
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d /= n
        flat = d.reshape(-1, d.shape[2])
        grad_out = both.reshape(-1, both.shape[2]).T @ flat
        dboth = d @ self.out.T
        hid = self.ahead.state.shape[0]
        a = self.ahead.backward(x, kept_a, dboth[:, :, :hid])
        b = self.behind.backward(x[:, ::-1], kept_b, dboth[::-1, :, hid:])
        return loss, [a.byte, a.state, a.bias, b.byte, b.state, b.bias, grad_out, flat.sum(axis=0)]

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> LanguageModel:
        """Adam over batches of spans of one length, each span of every whole text once an epoch, in an order drawn from seed.

        Few spans are taken in smaller batches, so that an epoch has some hundred steps.
        """
        rng = np.random.default_rng(seed)
        data, start, size, owner, _ = spans([np.frombuffer(t, np.uint8) for t in texts])
        groups = [np.flatnonzero(size == n) for n in np.unique(size).tolist()]
        batch = max(16, min(batch, len(size) // 120))
        parts = self._parts()
        first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
        steps = epochs * sum(-(-len(g) // batch) for g in groups)
        for _ in range(epochs):
            plan = []
            for g in groups:
                order = rng.permutation(g)
                plan += [order[i : i + batch] for i in range(0, len(order), batch)]
            for k in rng.permutation(len(plan)):
                rows = plan[k]
                _, grads = self.gradients(data[start[rows][:, None] + np.arange(size[rows[0]])], y[owner[rows]])
                step += 1
                scale = rate * 0.05 ** (step / steps) * min(1.0, len(rows) / batch + 0.1) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for p, m, v, g_ in zip(parts, first, second, grads):
                    m += 0.1 * (g_ - m)
                    v += 0.001 * (g_ * g_ - v)
                    p -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of the languages' probabilities over its bytes that are parts of letters, and their number.

        A text is read span by span; its last span ends where it ends and counts from where the one before ended.
        """
        data, start, size, owner, skip = spans(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts), np.int64)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            for i in range(0, len(rows), ROWS):
                part = rows[i : i + ROWS]
                x = data[start[part][:, None] + np.arange(n)]
                counts = (_LETTER[x] & (np.arange(n) >= skip[part][:, None])).T
                np.add.at(total, owner[part], np.einsum("trk,tr->rk", self.labels(x), counts.astype(np.float32)))
                np.add.at(count, owner[part], counts.sum(axis=0))
        return total, count

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language of each text and its pooled probability."""
        found = texts.to_pylist()
        blank = np.array([not any(map(str.isalpha, t or "")) for t in found], bool)
        read = np.flatnonzero(~blank) if self.languages else np.zeros(0, np.int64)
        langs, scores = [UNKNOWN] * len(found), [0.0] * len(found)
        if len(read):
            total, count = self.pooled([np.frombuffer(found[i].encode("utf-8", "surrogatepass"), np.uint8) for i in read.tolist()])
            share = total / np.maximum(count, 1)[:, None]
            for i, k, s in zip(read.tolist(), share.argmax(axis=1).tolist(), share.max(axis=1).tolist()):
                langs[i], scores[i] = self.languages[k], round(min(1.0, s), 6)
        return langs, scores


def spans(texts: list[np.ndarray], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """All bytes, and each span's start, size, text, and the number of its bytes that the span before holds already."""
    long = np.array([len(t) for t in texts], np.int64)
    n = -(-long // span)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(span, long[owner])
    at = np.minimum(nth * span, long[owner] - size)
    begin = np.cumsum(long) - long
    return np.concatenate(texts) if texts else np.zeros(0, np.uint8), begin[owner] + at, size, owner, nth * span - at


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def training_rows(docs: DataFrame, sample: int = SAMPLE, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, lang, text of the documents that a model learns from: the first ones of every language by hash of doc_id.

    They are taken from the languages in turn until there are `sample` of them. Rows with a null text, lang or doc_id and
    those of the held-out fold are none of them; of rows that share a doc_id the least counts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where((fold(folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keys = rows.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("doc_id"))
    # a language that most documents are of is cut down in parts before one task sees it
    for parts in ([F.pmod("h", F.lit(SALTS))], []):
        keys = keys.withColumn("turn", F.row_number().over(Window.partitionBy("lang", *parts).orderBy("h", "doc_id"))).where(F.col("turn") <= sample)
    keys = keys.orderBy("turn", "h", "doc_id").limit(sample).select("doc_id", "turn", "h")
    # a line for each of at most `sample` documents: its size is bounded
    met = rows.join(F.broadcast(keys), "doc_id").groupBy("doc_id", "turn", "h").agg(F.min(F.struct("lang", "text")).alias("r"))
    return met.select("doc_id", "turn", "h", "r.lang", "r.text")


def fit_languages(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> LanguageModel:
    """A model of documents' lang, from the whole texts of at most `sample` documents and about `most` bytes of them together.

    One document is learned from in any case; which ones, see training_rows. Without rows the model knows no language and
    calls every text unknown.
    """
    rows = written(training_rows(docs, sample), "languages-sample")
    before = Window.orderBy("turn", "h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of `sample` rows, in one task
    held = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    drawn = sorted((r["doc_id"], r["lang"], r["text"]) for r in held.where(F.col("before") <= most).collect())
    languages = sorted({lang for _, lang, _ in drawn})
    number = {name: i for i, name in enumerate(languages)}
    texts = [t.encode("utf-8", "surrogatepass") for _, _, t in drawn]
    model = LanguageModel.fresh(languages)
    return model.fit(texts, np.array([number[lang] for _, lang, _ in drawn], np.int64)) if any(texts) else model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score.

    lang_pred is `und`, with score 0, for a null text or one without a letter. Only the text is looked at. Null and
    repeated doc_ids are kept. An empty table gives an empty result. Nothing is shuffled. The network reads a whole text in
    spans of SPAN bytes, across words, labels every byte, and a text's probabilities are the mean over the bytes of its
    letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, 1, BLOCK)):
            langs, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_byte_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit_languages(docs))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
