"""Operator 4: AVI motion-JPEG: lossless intra frames in a RIFF file, read back, and clips between detected shots."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import table

WIDTH = 64
HEIGHT = 64
FPS = 25
#: Bins of a frame's histogram, frames of the window that the threshold adapts to, and how far above its mean a cut is.
BINS = 16
WINDOW = 12
ABOVE = 3.0
LEAST = 0.08

#: Fixed values of the JPEG format: markers.
SOI, EOI, SOF0, SOF3, DHT, SOS, DQT, DRI = 0xD8, 0xD9, 0xC0, 0xC3, 0xC4, 0xDA, 0xDB, 0xDD

#: Code lengths by difference category: category 0 has 9 bits, 1 has 8, ... 8 has 1; with its extra bits every
#: difference of 8-bit samples then takes exactly 9 bits, so that a frame is read without walking from code to code.
SYMBOL_BITS = 9
CODE_LENGTH = (9, 8, 7, 6, 5, 4, 3, 2, 1)


def canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """A DHT segment's codes: (length, code) -> symbol."""
    code, at, found = 0, 0, {}
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[(length, code)] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


_COUNTS = [CODE_LENGTH.count(n) for n in range(1, 17)]
_SYMBOLS = [CODE_LENGTH.index(n) for n in range(1, 10)]
_CODES = {s: (n, c) for (n, c), s in canonical(_COUNTS, _SYMBOLS).items()}


def _words() -> np.ndarray:
    """The 9 bits of every difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        length, code = _CODES[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        out[d + 255] = code << cat | extra
    return out


_WORD = _words()
_DIFF = np.full(1 << SYMBOL_BITS, -1000, np.int16)
_DIFF[_WORD] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = _segment(DHT, bytes([0, *_COUNTS, *_SYMBOLS]))


def _differences(frame: np.ndarray) -> np.ndarray:
    """Sample minus prediction: the left neighbour, in the first column the one above, at the start 128."""
    x = frame.astype(np.int16)
    d = np.empty_like(x)
    d[:, 1:] = x[:, 1:] - x[:, :-1]
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[0, 0] = x[0, 0] - 128
    return d


def encode_frame(frame: np.ndarray) -> bytes:
    """A grey 8-bit image as lossless JPEG (process 14, predictor 1)."""
    rows, cols = frame.shape
    words = _WORD[_differences(frame).ravel() + 255]
    bits = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - SYMBOL_BITS :].ravel()
    if len(bits) % 8:
        bits = np.concatenate((bits, np.ones(8 - len(bits) % 8, np.uint8)))
    data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(SOF3, struct.pack(">BHHBBBB", 8, rows, cols, 1, 1, 0x11, 0))
    scan = _segment(SOS, bytes([1, 1, 0, 1, 0, 0]))
    return b"\xff\xd8" + _TABLES + head + scan + data + b"\xff\xd9"


@dataclass
class Frame:
    rows: int
    cols: int
    tables: dict
    data: bytes
    predictor: int


def parse_frame(jpeg: bytes) -> Frame:
    """The segments of a single-component lossless JPEG."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, tables, shape = 2, {}, None
    while at < len(jpeg):
        _, marker, size = struct.unpack_from(">BBH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (list(body[1:17]), list(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == SOF3:
            precision, rows, cols, parts = struct.unpack_from(">BHHB", body)
            if precision != 8 or parts != 1:
                raise ValueError("only grey 8-bit frames are read")
            shape = rows, cols
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError(f"frames of process {marker:#x} are not read: they are not lossless")
        elif marker == SOS:
            end = jpeg.rindex(b"\xff\xd9")
            return Frame(*shape, tables, jpeg[at:end].replace(b"\xff\x00", b"\xff"), body[-3])
    raise ValueError("no scan")


def _walk(frame: Frame) -> np.ndarray:
    """Differences of any table, code by code."""
    codes = canonical(*frame.tables[0])
    bits = np.unpackbits(np.frombuffer(frame.data, np.uint8)).tolist()
    out, at = [], 0
    for _ in range(frame.rows * frame.cols):
        code, length = 0, 0
        while (length, code) not in codes:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        cat, extra = codes[(length, code)], 0
        for _ in range(cat):
            extra, at = extra << 1 | bits[at], at + 1
        out.append(extra if cat == 0 or extra >> (cat - 1) else extra - (1 << cat) + 1)
    return np.array(out, np.int16)


def decode_frame(jpeg: bytes) -> np.ndarray:
    frame = parse_frame(jpeg)
    if frame.predictor != 1:
        raise ValueError("only predictor 1 is read")
    n = frame.rows * frame.cols
    if frame.tables.get(0) == (_COUNTS, _SYMBOLS):
        bits = np.unpackbits(np.frombuffer(frame.data, np.uint8), count=n * SYMBOL_BITS).reshape(n, SYMBOL_BITS)
        words = (bits[:, 0].astype(np.uint16) << 8) | np.packbits(bits[:, 1:], axis=1).ravel()
        d = _DIFF[words]
    else:
        d = _walk(frame)
    d = d.reshape(frame.rows, frame.cols).astype(np.int32)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    """payload (a positive multiple of width) as an AVI file of one MJPG stream with an index.

    Frames are width x height samples, row by row; the last one may have fewer rows, which its own header tells.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    frames = [encode_frame(samples[i : i + height]) for i in range(0, len(samples), height)]
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [], [], 4
    for x in frames:
        movi.append(_chunk(b"00dc", x))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass
class Movie:
    width: int
    height: int
    micros: int  #: for each frame
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def _leaves(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a movi list, those inside its rec lists too."""
    for name, a, size in _chunks(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _chunks(data, a + 4, a + size)
        else:
            yield name, a, size


def _frame_names(data: bytes, at: int, end: int) -> tuple[bytes, bytes]:
    """The names of the chunks of the first video stream among the headers."""
    streams = [(a, s) for n, a, s in _chunks(data, at, end) if n == b"LIST" and data[a : a + 4] == b"strl"]
    for i, (a, size) in enumerate(streams):
        if any(n == b"strh" and data[h : h + 4] == b"vids" for n, h, _ in _chunks(data, a + 4, a + size)):
            return b"%02ddc" % i, b"%02ddb" % i
    raise ValueError("there is no video stream")


def parse_avi(data: bytes) -> Movie:
    """Headers and the first video stream's frames: those that the index names or, without one, those in the movi list.

    An index may count from the list's type, as here, or from the file's start; which of the two, its first frame tells.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avih, movi, index, names = None, None, None, ()
    for name, at, size in _chunks(data, 12, len(data)):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            avih = next((struct.unpack_from("<14I", data, a) for n, a, _ in _chunks(data, at + 4, at + size) if n == b"avih"), None)
            names = _frame_names(data, at + 4, at + size)
        elif name == b"LIST" and kind == b"movi":
            movi = at, size
        elif name == b"idx1":
            index = at, size
    if avih is None or movi is None:
        raise ValueError("headers or frames are missing")
    if not index:
        frames = [data[a : a + s] for n, a, s in _leaves(data, movi[0] + 4, movi[0] + movi[1]) if n in names]
        return Movie(avih[8], avih[9], avih[0], frames)
    entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if e[0] in names]
    there = lambda at, name, size: data[at : at + 8] == name + struct.pack("<I", size)
    base = next((b for b in (movi[0], 0) for name, _, offset, size in entries[:1] if there(b + offset, name, size)), movi[0])
    if not all(there(base + offset, name, size) for name, _, offset, size in entries):
        raise ValueError("the index doesn't match the frames")
    return Movie(avih[8], avih[9], avih[0], [data[base + o + 8 : base + o + 8 + s] for _, _, o, s in entries])


def cuts(frames: list[np.ndarray], bins: int = BINS, window: int = WINDOW, above: float = ABOVE, least: float = LEAST) -> list[int]:
    """The frames that begin a shot (the first one not named).

    A frame begins a shot if its histogram differs from the one before by at least `least` and by more than the mean
    plus `above` standard deviations of the differences in the window before it since the last cut; a window of fewer
    than two differences has no say, and only four times `least` counts as a cut then.
    """
    hist = np.array([np.bincount(f.ravel() >> 4, minlength=bins)[:bins] / f.size for f in frames])
    change = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    found, seen = [], []
    for i, x in enumerate(change.tolist(), 1):
        past = seen[-window:]
        limit = 4 * least if len(past) < 2 else max(least, float(np.mean(past) + above * np.std(past)))
        if x >= limit and x >= least:
            found.append(i)
            seen = []
        else:
            seen.append(x)
    return found


def clips(movie: Movie, frames: list[np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """(first frame, last frame, start in ms, end in ms) of each shot."""
    frames = frames if frames is not None else [decode_frame(x) for x in movie.frames]
    if not frames:
        return []
    begin = [0, *cuts(frames)]
    end = [*(b - 1 for b in begin[1:]), len(frames) - 1]
    ms = movie.micros / 1000
    return [(a, b, round(a * ms), round((b + 1) * ms)) for a, b in zip(begin, end)]


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


CLIP = "array<struct<first: int, last: int, start_ms: long, end_ms: long>>"
STORED = f"doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, frames int, levels double, clips {CLIP}"
_CLIP_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))
_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), _CLIP_TYPE)
_NAMES = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "frames", "levels", "clips"]
#: Bytes of media that a batch handed on to Spark holds, about.
BATCH = 4 << 20


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            n, payload = payload_of(text.as_py())
            media = encode_avi(payload)
            movie = parse_avi(media)
            frames = [decode_frame(x) for x in movie.frames]
            read = b"".join(f.tobytes() for f in frames)
            found = [dict(zip(("first", "last", "start_ms", "end_ms"), c)) for c in clips(movie, frames)]
            mean = round(float(np.frombuffer(read, np.uint8).mean()), 6)
            rows.append((doc_id, n, media, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-WIDTH:]), len(frames), mean, found))
            size += len(media)
            if size > BATCH:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


def store_media(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, the AVI file (media), what was read back from it, and its clips.

    The payload, the text's UTF-8 and zero bytes up to a positive multiple of 64, becomes grey frames of 64 x 64
    samples, coded as lossless JPEG (a DCT would not give the bytes back), the last frame with as many rows as are
    left. A null text is empty; an empty text gives one frame of one black row. Null and repeated doc_ids are kept. An
    empty table gives an empty result. Other columns are not looked at. Texts are taken one by one; nothing is
    shuffled.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored, STORED)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip, first, last, start_ms, end_ms."""
    rows = media.select("doc_id", F.posexplode("clips").alias("clip", "c"))
    return rows.select("doc_id", "clip", "c.first", "c.last", "c.start_ms", "c.end_ms")


def op4_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored AVI and read back: sizes, digests, frames and clips."""
    out = store_media(table(spark, sf_dir, "documents"))
    shots = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"].cast("string"), c["end_ms"].cast("string"))), ",")
    feature = F.format_string("frames=%d mean=%.6f clips_ms=%s", "frames", "levels", shots)
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
