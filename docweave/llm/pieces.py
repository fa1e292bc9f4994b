"""Operator 1: SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie, in numpy."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import blocks, table

#: Where the vocabulary is, unless a caller names another file.
MODEL = os.environ.get("DOCWEAVE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Bytes of text that are split together, and bytes of different words that go through the trie together.
TEXT_BLOCK = 4 << 20
WORD_BLOCK = 1 << 17


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


def _grown(used: bytearray, *arrays: np.ndarray) -> list:
    return [used + bytearray(len(used)), *(np.concatenate((x, np.full(len(x), f, np.int32))) for x, f in zip(arrays, (0, -1, -1)))]


@dataclass
class DoubleArray:
    """A trie of byte strings: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        values = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                nxt = tree[node].get(c)
                if nxt is None:
                    nxt = tree[node][c] = len(tree)
                    tree.append({})
                    values.append(-1)
                node = nxt
            values[node] = v
        size = 2 * len(tree) + 512
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        slot, free, hint = {0: 0}, 257, 257  # so that no base is below 0
        for node in range(len(tree)):  # parents were made before their children
            codes = sorted(tree[node])
            s = slot.pop(node)
            value[s] = values[node]
            if not codes:
                continue
            while free + 257 >= len(used) or used[free]:
                if free + 257 >= len(used):
                    used, base, check, value = _grown(used, base, check, value)
                else:
                    free += 1
            # nodes of several children look on from where the last ones took long to find a place
            b, tries = (free if len(codes) == 1 else max(free, hint)) - codes[0] - 1, 0
            while any(used[b + c + 1] for c in codes):
                b, tries = b + 1, tries + 1
                if b + 257 >= len(used):
                    used, base, check, value = _grown(used, base, check, value)
            if tries > 50:
                hint = b
            base[s] = b
            for c in codes:
                used[b + c + 1], check[b + c + 1] = 1, s
                slot[tree[node][c]] = b + c + 1
        return cls(base, check, value)


@dataclass
class Pieces:
    """A vocabulary: pieces, scores, the trie over those that text can match, and tables for decoding."""

    names: list[str]
    scores: np.ndarray
    types: list[int]
    dummy_prefix: bool = True
    trie: DoubleArray = field(init=False)

    def __post_init__(self):
        ids = range(len(self.names))
        self.trie = DoubleArray.build({self.names[i].encode(): i for i in ids if self.types[i] in (NORMAL, USER)})
        normal = [self.scores[i] for i in ids if self.types[i] == NORMAL]
        self.unknown_score = float(min(normal, default=0.0)) - UNKNOWN_PENALTY
        self.unknown = next((i for i in ids if self.types[i] == UNKNOWN), 0)
        byte = {int(self.names[i][3:5], 16): i for i in ids if self.types[i] == BYTE}
        self.byte = np.array([byte.get(b, self.unknown) for b in range(256)], np.int32)
        self.is_byte = np.array([t == BYTE for t in self.types])
        # pieces with the marker inside can't be split from what comes before the marker unless it is a run of markers
        self.runs_only = all(set(n) == {MARK} or MARK not in n[1:].lstrip(MARK) for n in self.names if MARK in n[1:])
        raw = [self._bytes(i) for i in ids]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def _bytes(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.names[i][3:5], 16)])
        if self.types[i] == CONTROL:
            return b""
        return (" ⁇ " if self.types[i] == UNKNOWN else self.names[i].replace(MARK, " ")).encode()

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        """Reads a SentencePiece model file whose normaliser leaves text as it is; scores are taken as log scores."""
        names, scores, types, prefix = [], [], [], True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only vocabularies whose normaliser keeps text as it is can be used")
        return cls(names, np.array(scores, np.float64), types, prefix)

    # encoding

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The best pieces of each word (UTF-8, markers in place): all ids, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        if not size.sum():
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        end = (begin + size)[word]
        lead = (buf & 0xC0) != 0x80
        start, end_of, id_of = self._matches(buf, lead, end)
        # where no piece goes on, a word's best path is the best paths of the parts before and after
        over = np.cumsum(np.bincount(start + 1, minlength=len(buf) + 1) - np.bincount(end_of, minlength=len(buf) + 1))
        parts = np.flatnonzero(lead & (over[: len(buf)] == 0))
        parts = np.union1d(parts, begin[size > 0])
        part = np.zeros(len(buf), np.int64)
        part[parts] = 1
        ids, counts = self._best(buf, parts, np.diff(np.append(parts, len(buf))), np.cumsum(part) - 1, start, end_of, id_of)
        return ids, np.bincount(word[parts], counts, len(words)).astype(np.int64)

    def _matches(self, buf, lead, end):
        """Every piece found at every character: first byte, byte after the last, id; unknown characters included."""
        trie = self.trie
        start = np.flatnonzero(lead)
        at, state = start, np.zeros(len(start), np.int32)
        out_start, out_end, out_id = [], [], []
        char = np.append(start, len(buf))
        after = np.empty(len(buf), np.int64)
        after[start] = char[1:]
        single = np.zeros(len(buf), bool)
        while len(start):
            nxt = trie.base[state] + buf[at] + 1
            ok = trie.check[nxt] == state
            start, at, state = start[ok], at[ok] + 1, nxt[ok]
            found = trie.value[state]
            hit = found >= 0
            s, e = start[hit], at[hit]
            out_start.append(s)
            out_end.append(e)
            out_id.append(found[hit])
            single[s[e == after[s]]] = True
            more = at < end[start]
            start, at, state = start[more], at[more], state[more]
        lone = np.flatnonzero(lead & ~single)
        out_start.append(lone)
        out_end.append(after[lone])
        out_id.append(np.full(len(lone), -1, np.int32))
        return np.concatenate(out_start), np.concatenate(out_end), np.concatenate(out_id)

    def _best(self, buf, begin, size, word, start, end, ids):
        score = np.where(ids >= 0, self.scores[ids], self.unknown_score)
        slot = start + word[start]  # every word has a place more than it has bytes
        goal = end + word[start]
        rel = end - begin[word[start]]
        order = np.lexsort((start, word[start], rel))
        slot, goal, score, ids, rel = slot[order], goal[order], score[order], ids[order], rel[order]
        n = len(buf) + len(size)
        best, back, via = np.full(n, -np.inf), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        best[begin + np.arange(len(size))] = 0.0
        group = np.flatnonzero(np.concatenate(([True], goal[1:] != goal[:-1])))
        bound = np.append(group, len(goal))
        level = rel[group]
        steps = np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))
        for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(group)]):
            lo, hi = bound[a], bound[b]
            total = best[slot[lo:hi]] + score[lo:hi]
            heads = group[a:b] - lo
            most = np.maximum.reduceat(total, heads)
            widths = np.diff(np.append(heads, hi - lo))
            first = np.where(total == np.repeat(most, widths), np.arange(hi - lo), hi - lo)
            pick = np.minimum.reduceat(first, heads) + lo
            to = goal[pick]
            best[to], back[to], via[to] = most, slot[pick], pick
        # back from the ends, one piece of every word at a time
        cur = begin + size + np.arange(len(size))
        stop = begin + np.arange(len(size))
        who = np.flatnonzero(cur != stop)
        got_word, got_pick = [], []
        cur = cur[who]
        while len(who):
            got_word.append(who)
            got_pick.append(via[cur])
            cur = back[cur]
            on = cur != stop[who]
            who, cur = who[on], cur[on]
        steps = np.repeat(np.arange(len(got_word)), [len(x) for x in got_word])
        got_word, got_pick = np.concatenate(got_word), np.concatenate(got_pick)
        order = np.lexsort((-steps, got_word))
        got_word, got_pick = got_word[order], got_pick[order]
        found = ids[got_pick]
        # unknown characters become the bytes they are made of
        unknown = found < 0
        width = np.where(unknown, goal[got_pick] - slot[got_pick], 1)
        out = np.repeat(found, width)
        if unknown.any():
            from_byte = np.repeat(slot[got_pick] - got_word, width) + np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
            spread = np.repeat(unknown, width)
            out[spread] = self.byte[buf[from_byte[spread]]]
        return out.astype(np.int32), np.bincount(np.repeat(got_word, width), minlength=len(size))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and how many each has.

        No piece reaches over a marker but runs of markers, so a text's best path is the best paths of its words, a
        word being a run of spaces and what follows up to the next; each different word is looked up once.
        """
        if not self.runs_only:
            raise ValueError("the vocabulary has pieces that go on after a marker")
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = not self.dummy_prefix  # words then come with their own markers, or without one at a text's start
        words = pc.split_pattern(texts, " ")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " "))).to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd = odd | whole
        if odd.any() or empty.any():
            split = words.to_pylist()
            for i in np.flatnonzero(odd).tolist():
                text = texts[i].as_py()
                split[i] = [w if whole else w[1:] for w in re.findall(" +[^ ]*|[^ ]+", text if whole else " " + text)]
            for i in np.flatnonzero(empty).tolist():
                split[i] = []
            words = pa.array(split, pa.large_list(pa.large_string()))
        coded = words.flatten().dictionary_encode() if len(words.flatten()) else None
        per_text = np.diff(words.offsets.to_numpy())
        if coded is None:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        different = coded.dictionary.to_pylist()
        ids, counts, held, size = [], [], [], 0
        for w in different:
            data = (("" if whole else MARK) + w.replace(" ", MARK)).encode()
            held.append(data)
            size += len(data)
            if size > WORD_BLOCK:
                part = self.encode_words(held)
                ids.append(part[0])
                counts.append(part[1])
                held, size = [], 0
        if held:
            part = self.encode_words(held)
            ids.append(part[0])
            counts.append(part[1])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        at = np.cumsum(counts) - counts
        index = coded.indices.to_numpy()
        n = counts[index]
        flat = ids[np.repeat(at[index] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        word_end = np.concatenate(([0], np.cumsum(n)))
        text_end = np.concatenate(([0], np.cumsum(per_text)))
        return flat, np.diff(word_end[text_end])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.large_string()))[0].tolist()

    # decoding

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each sequence: markers become spaces, the one in front goes, byte pieces are the bytes they name."""
        n = self.raw_size[ids]
        data = self.raw[np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        return [x[1:] if self.dummy_prefix and x[:1] == b" " else x for x in out]

    def decode(self, ids: list[int]) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_batch(ids, np.array([len(ids)]))[0].decode("utf-8", "replace")


ROUND_TRIP = "doc_id long, ids array<int>, n_byte_pieces long, decoded string, exact boolean"


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of docs: doc_id, ids, n_byte_pieces, decoded, exact (whether decoded is the text).

    A null or empty text has no ids and is decoded as empty text. Text that holds the marker character itself comes back
    with spaces in its place and is not exact, as the format has it; all else comes back as it was. Null and repeated
    doc_ids are kept. An empty table gives an empty result. Other columns are not looked at. Nothing is shuffled; the
    vocabulary goes to the executors once, and its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in blocks(whole, 1, TEXT_BLOCK):
                ids, counts = own.encode_batch(batch.column(1))
                at = np.concatenate(([0], np.cumsum(counts)))
                byte = np.concatenate(([0], np.cumsum(own.is_byte[ids])))[at]
                decoded = pa.array([x.decode("utf-8", "replace") for x in own.decode_batch(ids, counts)], pa.string())
                exact = pc.equal(decoded, pc.fill_null(batch.column(1), ""))
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(np.diff(byte), pa.int64()), decoded, exact], ["doc_id", "ids", "n_byte_pieces", "decoded", "exact"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROUND_TRIP)


def piece_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """Per row of docs what round_trip() gives, in numbers and digests instead of pieces and texts; odd rows are as there."""
    out = round_trip(docs, pieces)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "exact",
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, counted and digested, and what decoding them gives."""
    return piece_counts(table(spark, sf_dir, "documents"), Pieces.load())
