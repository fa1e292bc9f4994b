from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import pieces as p

PIECES = p.Pieces.load()


def unigram_model() -> bytes:
    """The same pieces and scores as a Unigram model that the reference library can load."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    with open(p.MODEL, "rb") as f:
        data = f.read()
    out = b""
    for number, value in p._fields(data):
        if number == 1:
            piece = dict(p._fields(value))
            score = max(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, -40000.0)
            body = b"\x0a" + varint(len(piece[1])) + piece[1] + b"\x15" + struct.pack("<f", score) + (b"\x18" + varint(piece[3]) if 3 in piece else b"")
            out += b"\x0a" + varint(len(body)) + body
        elif number == 2:
            body = b""
            for field, content in p._fields(value):
                if field == 3:
                    body += b"\x18\x01"
                elif isinstance(content, int):
                    body += varint(field << 3) + varint(content)
                else:
                    body += varint(field << 3 | (5 if len(content) == 4 and field > 7 else 2)) + (b"" if len(content) == 4 and field > 7 else varint(len(content))) + content
            out += b"\x12" + varint(len(body)) + body
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def both(tmp_path_factory):
    import sentencepiece

    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(unigram_model())
    return sentencepiece.SentencePieceProcessor(model_proto=path.read_bytes()), p.Pieces.load(str(path))


@pytest.mark.parametrize("text", ["Hello world", "The quick brown fox", "naïve café", "tab\tand\nline", "日本語 mixed with English", "𝄞 unknown", "aaaaaaaaaaaaaaaaaaaa", "x"])
def test_equals_the_library(both, text):
    library, own = both
    assert own.encode(text) == library.encode(text)


def brute(own: p.Pieces, word: str) -> float:
    best = [0.0] + [-np.inf] * len(word)
    names = {own.names[i]: own.scores[i] for i in range(len(own.names)) if own.types[i] in (p.NORMAL, p.USER)}
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + 50) + 1):
            if word[i:j] in names:
                best[j] = max(best[j], best[i] + names[word[i:j]])
        if word[i] not in names:
            best[i + 1] = max(best[i + 1], best[i] + own.unknown_score)
    return best[-1]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdeilnorst▁é日\n", min_size=1, max_size=14))
def test_best_score(word):
    word = "▁" + word.replace("▁", "")
    ids, counts = PIECES.encode_words([word.encode()])
    names = [PIECES.names[i] for i in ids]
    total = sum(PIECES.scores[i] for i in ids if not PIECES.is_byte[i])
    unknown = [c for c in word if c not in PIECES.names]
    assert total + PIECES.unknown_score * len(unknown) == pytest.approx(brute(PIECES, word))
    assert counts.tolist() == [len(names)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="▁"), max_size=40), max_size=5))
def test_round_trip(texts):
    ids, counts = PIECES.encode_batch(pa.array(texts, pa.string()))
    assert [x.decode() for x in PIECES.decode_batch(ids, counts)] == texts


@pytest.mark.parametrize("text", ["a \0b", "\0", " lead", "two  spaces ", "a", "\0\0 \0", "日本 語"])
def test_without_a_prefix(text):
    """A vocabulary that puts no marker in front: zero bytes and leading spaces come back as they were."""
    own = p.Pieces(PIECES.names, PIECES.scores, PIECES.types, dummy_prefix=False)
    assert own.decode(own.encode(text)) == text
    assert own.encode("b" + text) != PIECES.encode("b" + text)


def test_unbroken_text_is_cut_only_where_no_piece_goes_on():
    text = "▁" + "".join("日本éxyzabcthe"[(i * i) % 14] for i in range(3000))
    ids, counts = PIECES.encode_words([text.encode(), "▁the".encode()])
    total = sum(PIECES.scores[i] for i in ids[: counts[0]] if not PIECES.is_byte[i])
    unknown = [c for c in text if c not in PIECES.names]
    assert total + PIECES.unknown_score * len(unknown) == pytest.approx(brute(PIECES, text))
    assert ids[counts[0] :].tolist() == PIECES.encode("the")


def test_double_array_finds_every_key_and_no_other():
    keys = {bytes([a, b]): a * 256 + b for a in range(0, 256, 5) for b in range(0, 256, 7)} | {b"\xff": 1, b"abcdefgh": 2}
    trie = p.DoubleArray.build(keys)

    def get(key: bytes) -> int:
        node = 0
        for c in key:
            nxt = trie.base[node] + c + 1
            if nxt >= len(trie.check) or trie.check[nxt] != node:
                return -1
            node = nxt
        return int(trie.value[node])

    assert all(get(k) == v for k, v in keys.items())
    assert get(b"abc") == -1 and get(b"zz\x00") == -1


def test_odd_rows(odd, none):
    found = [r.asDict() for r in p.round_trip(odd, PIECES).collect()]
    assert len(found) == odd.count()
    for r in found:
        assert r["exact"] == (r["doc_id"] != 9)  # the marker itself comes back as a space
    empty = [r for r in found if r["doc_id"] in (1, 2)]
    assert all(r["ids"] == [] and r["decoded"] == "" for r in empty)
    assert p.piece_counts(none, PIECES).count() == 0
