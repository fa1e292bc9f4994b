from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import avi


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.sampled_from([8, 64]))
def test_round_trip(data, height):
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    movie = avi.parse_avi(avi.encode_avi(payload, height=height))
    assert b"".join(avi.decode_frame(x).tobytes() for x in movie.frames) == payload
    assert (movie.width, movie.height, movie.micros) == (64, height, 40_000)


def test_other_tables_are_read_code_by_code():
    """A frame whose table isn't the one that is written here: categories 0 to 8 with codes of 2, 3, 3, 3, ... bits."""
    counts, symbols = [0, 1, 5, 1, 1, 1] + [0] * 10, list(range(9))
    codes = {s: (n, c) for (n, c), s in avi.canonical(counts, symbols).items()}
    frame = np.random.default_rng(1).integers(0, 256, (5, 64)).astype(np.uint8)
    bits = ""
    for d in avi._differences(frame).ravel().tolist():
        cat = abs(d).bit_length()
        length, code = codes[cat]
        bits += format(code, f"0{length}b") + (format(d if d >= 0 else d + (1 << cat) - 1, f"0{cat}b") if cat else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = avi._segment(avi.DHT, bytes([0, *counts, *symbols])) + avi._segment(avi.SOF3, struct.pack(">BHHBBBB", 8, 5, 64, 1, 1, 0x11, 0))
    jpeg = b"\xff\xd8" + head + avi._segment(avi.SOS, bytes([1, 1, 0, 1, 0, 0])) + data + b"\xff\xd9"
    assert (avi.decode_frame(jpeg) == frame).all()


def test_without_an_index_and_with_a_wrong_one():
    data = avi.encode_avi(bytes(range(256)) * 64)
    at = data.rindex(b"idx1")
    assert len(avi.parse_avi(data[:at]).frames) == 4
    broken = bytearray(data)
    broken[at + 8 + 8] ^= 1
    with pytest.raises(ValueError):
        avi.parse_avi(bytes(broken))
    with pytest.raises(ValueError):
        avi.parse_avi(b"RIFF0000WAVE")


def _movie(parts, absolute=False, indexed=True):
    """An AVI file of a sound stream and a video stream; parts: (name, body) chunks, a list of them being a rec list."""
    avih = struct.pack("<14I", 40_000, 0, 0, 0x10, 2, 0, 2, 0, 64, 64, 0, 0, 0, 0)
    streams = b"".join(avi._list(b"strl", avi._chunk(b"strh", kind + bytes(52))) for kind in (b"auds", b"vids"))
    head = avi._list(b"hdrl", avi._chunk(b"avih", avih) + streams)
    movi, index, begin = b"", [], 12 + len(head) + 8
    for part in parts:
        inner = part if isinstance(part, list) else [part]
        at = len(movi) + 4 + (12 if isinstance(part, list) else 0)
        if isinstance(part, list):
            index.append(struct.pack("<4sIII", b"rec ", 1, at - 12 + begin * absolute, 0))
        for name, body in inner:
            index.append(struct.pack("<4sIII", name, 0x10, at + begin * absolute, len(body)))
            at += len(avi._chunk(name, body))
        held = b"".join(avi._chunk(*x) for x in inner)
        movi += avi._list(b"rec ", held) if isinstance(part, list) else held
    body = b"AVI " + head + avi._list(b"movi", movi) + (avi._chunk(b"idx1", b"".join(index)) if indexed else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("absolute, indexed", [(False, True), (True, True), (False, False)])
def test_indexes_of_both_kinds_rec_lists_and_streams(absolute, indexed):
    shots = [np.random.default_rng(i).integers(0, 256, (64, 64)).astype(np.uint8) for i in range(3)]
    coded = [avi.encode_frame(x) for x in shots]
    parts = [(b"00wb", b"sound"), (b"01dc", coded[0]), [(b"00wb", b"more"), (b"01dc", coded[1])], (b"01db", coded[2]), (b"00dc", b"no frame of the video stream")]
    movie = avi.parse_avi(_movie(parts, absolute, indexed))
    assert all((avi.decode_frame(x) == y).all() for x, y in zip(movie.frames, shots)) and len(movie.frames) == 3


def test_shots():
    rng = np.random.default_rng(0)
    dark, light = (lambda: rng.integers(0, 60, (64, 64)).astype(np.uint8)), (lambda: rng.integers(150, 256, (64, 64)).astype(np.uint8))
    frames = [dark() for _ in range(8)] + [light() for _ in range(6)] + [dark() for _ in range(3)]
    assert avi.cuts(frames) == [8, 14]
    movie = avi.Movie(64, 64, 40_000, [])
    assert avi.clips(movie, frames) == [(0, 7, 0, 320), (8, 13, 320, 560), (14, 16, 560, 680)]
    assert avi.cuts([dark()]) == []


def test_odd_rows(odd, none):
    stored = avi.store_media(odd)
    found = {(r["doc_id"], r["payload_sha256"]): r for r in stored.collect()}
    texts = {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}
    for doc_id, text in texts:
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = found[(doc_id, hashlib.sha256(payload).hexdigest())]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
    assert stored.count() == odd.count()
    assert avi.clip_rows(stored).count() >= odd.count()
    assert avi.store_media(none).count() == 0
