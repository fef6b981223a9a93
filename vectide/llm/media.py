"""AVI motion-JPEG columns: build, parse by RIFF index, decode intra frames, cut into shots.

``texts_to_avi`` keeps bytes losslessly as the 8-bit grey samples of lossless JPEG frames
(process 14: predictor 1, Huffman-coded differences).  The Huffman table gives category ``s`` a
code of ``9 - s`` bits, so with its ``s`` extra bits each sample takes nine bits, and a frame can
be coded and decoded as arrays.  Other tables are decoded symbol by symbol.

``avi_clips`` reads motion-JPEG files: RIFF chunks, the ``idx1`` index of a file of one RIFF chunk,
or a walk over the ``movi`` lists and their ``rec`` lists where there is none or where more RIFF
chunks (``AVIX``) follow; then the frames, and shots by adaptive histogram differences.  Frames are
lossless, or baseline JPEG, of which the luminance is read (``baseline``); other kinds, such as
progressive frames, give an error row.

Nulls and odd input.  A null text is stored as the empty text.  A null media value or bytes that
are no readable AVI give ``frames`` null, no clips and a non-null ``error``; the row stays.
Repeated rows and equal texts give equal bytes.  Other columns pass through; those that are named
like the columns that are added are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm import baseline
from vectide.llm.common import cleared

#: Payload bytes are padded with this byte to a positive multiple of UNIT.
PAD, UNIT = 32, 192
#: Samples of a frame: four units.
WIDTH, HEIGHT = 32, 24
FPS = 25
#: A shot ends where the histogram difference is over mean + SPREAD deviations of the last WINDOW
#: differences and over FLOOR of the samples, at least LEAST frames after the last cut.
WINDOW, SPREAD, FLOOR, LEAST = 8, 3.0, 0.25, 4
BINS = 16

CLIPS = T.ArrayType(T.StructType([
    T.StructField("clip", T.IntegerType()),
    T.StructField("start_frame", T.IntegerType()),
    T.StructField("end_frame", T.IntegerType()),
    T.StructField("start_s", T.DoubleType()),
    T.StructField("end_s", T.DoubleType()),
]))

_CATEGORIES = range(8, -1, -1)


def _code_tables() -> tuple[np.ndarray, list[int], list[int]]:
    """Nine-bit word of each difference -255..255; JPEG's counts by length; its symbols."""
    words, code = np.zeros(511, np.uint16), 0
    for s in _CATEGORIES:
        length = 9 - s
        for extra in range(1 << s):
            value = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            if -255 <= value <= 255:
                words[value + 255] = code << s | extra
        code = (code + 1) << 1
    return words, [1] * 9 + [0] * 7, list(_CATEGORIES)


_WORDS, _COUNTS, _SYMBOLS = _code_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header(width: int, height: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, bytes([0, *_COUNTS, *_SYMBOLS]))
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of an array (frames, height, width) of bytes; width a multiple of 8."""
    x = samples.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    words = _WORDS[diff.reshape(len(x), -1, 8) + 255]
    out = np.empty((*words.shape[:2], 9), np.uint8)
    out[..., 0] = words[..., 0] >> 1
    for k in range(1, 8):
        out[..., k] = (words[..., k - 1] << (8 - k) | words[..., k] >> (k + 1)) & 255
    out[..., 8] = words[..., 7] & 255
    coded, size = out.tobytes(), out[0].size if len(out) else 0
    head = _frame_header(x.shape[2], x.shape[1])
    return [head + coded[i : i + size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(coded), size or 1)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, note: str = "") -> bytes:
    most, n = max(map(len, frames), default=0), len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", note.encode() + b"\0")) if note else b""
    body, index, at = [b"movi"], [], 4
    for f in frames:
        body.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def pad_payload(text: bytes) -> bytes:
    return text + bytes([PAD]) * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def payload_to_avi(payload: bytes) -> bytes:
    """The payload as frames; the last is filled up, and the comment holds the true size."""
    x = np.frombuffer(payload + bytes([PAD]) * (-len(payload) % (WIDTH * HEIGHT)), np.uint8)
    return write_avi(encode_frames(x.reshape(-1, HEIGHT, WIDTH)), WIDTH, HEIGHT, f"payload_bytes={len(payload)}")


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield bytes(data[at : at + 4]), at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_avi(media: bytes) -> dict:
    """fps, width, height, comment, and place and size of each frame by the index."""
    data = memoryview(media)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no RIFF AVI file")
    out, movi, index, riffs = {"fps": float(FPS), "comment": ""}, [], None, 0
    for riff, begin, length in _chunks(data, 0, len(data)):
        if riff != b"RIFF" or bytes(data[begin : begin + 4]) not in (b"AVI ", b"AVIX"):
            continue
        riffs += 1
        todo = [(begin + 4, begin + length)]
        while todo:
            for name, at, size in _chunks(data, *todo.pop()):
                if name == b"LIST":
                    if bytes(data[at : at + 4]) == b"movi":
                        movi.append((at, at + size))
                    else:
                        todo.append((at + 4, at + size))
                elif name == b"strh" and data[at : at + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, at + 20)
                    out["fps"] = rate / scale if scale and rate else out["fps"]
                elif name == b"avih":
                    out["width"], out["height"] = struct.unpack_from("<II", data, at + 32)
                elif name == b"ICMT":
                    out["comment"] = bytes(data[at : at + size]).rstrip(b"\0").decode("utf-8", "replace")
                elif name == b"idx1":
                    index = (at, size)
    if not movi:
        raise ValueError("no movi list")
    if index and riffs == 1:
        entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
        base = movi[0][0] if not entries or data[movi[0][0] + entries[0][2] : movi[0][0] + entries[0][2] + 4] == entries[0][0] else 0
        out["frames"] = [(base + at + 8, size) for _, _, at, size in entries]
    else:
        out["frames"] = [f for at, end in movi for f in _movi_frames(data, at + 4, end)]
    return out


def _movi_frames(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int]]:
    """The frames of a movi list in order, those of lists within it too, however deep."""
    open_ = [_chunks(data, at, end)]
    while open_:
        if (found := next(open_[-1], None)) is None:
            open_.pop()
        elif found[0] == b"LIST":
            open_.append(_chunks(data, found[1] + 4, found[1] + found[2]))
        elif found[0][2:] in (b"dc", b"db"):
            yield found[1], found[2]


class _Jpeg:
    """What the header of a lossless JPEG frame says, and how to decode what follows it."""

    def __init__(self, frame: bytes):
        at, lookup = 2, {}
        self.width = self.height = None
        if frame[:2] != b"\xff\xd8":
            raise ValueError("no JPEG frame")
        while True:
            if at + 4 > len(frame) or frame[at] != 0xFF:
                raise ValueError("broken JPEG header")
            marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
            body = frame[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC4:
                while body:
                    counts = body[1:17]
                    lookup[body[0]] = (counts, body[17 : 17 + sum(counts)])
                    body = body[17 + sum(counts) :]
            elif marker == 0xC3:
                bits, self.height, self.width, parts = struct.unpack(">BHHB", body[:6])
                if bits != 8 or parts != 1:
                    raise ValueError("only one 8-bit component is read")
            elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
                raise ValueError("only lossless sequential and baseline frames are read")
            elif marker == 0xDA:
                if body[3] != 1:
                    raise ValueError("only predictor 1 is read")
                table = lookup[body[2] >> 4]
                break
        if self.width is None:
            raise ValueError("no frame header")
        self.head = frame[:at]
        self.codes, code, k = {}, 0, 0
        for length, n in enumerate(table[0], 1):
            for _ in range(n):
                if table[1][k] > 15:
                    raise ValueError("a difference of more than 15 bits")
                self.codes[length, code] = table[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        self.words = None
        if {length + s for (length, _), s in self.codes.items()} == {9} and self.width % 8 == 0:
            self.words = np.zeros(512, np.int16)
            for (_, code), s in self.codes.items():
                for extra in range(1 << s):
                    self.words[code << s | extra] = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1

    def differences(self, coded: list[bytes]) -> np.ndarray:
        n = self.width * self.height
        if self.words is not None:
            b = np.frombuffer(b"".join(coded), np.uint8).reshape(len(coded), n // 8, 9).astype(np.uint16)
            out = np.empty((len(coded), n // 8, 8), np.int16)
            for k in range(8):
                out[..., k] = self.words[(b[..., k] << 8 | b[..., k + 1]) >> (7 - k) & 511]
        else:
            out = np.array([self._slow(c, n) for c in coded], np.int16)
        return out.reshape(len(coded), self.height, self.width)

    def _slow(self, coded: bytes, n: int) -> list[int]:
        bits, at, out = "".join(f"{b:08b}" for b in coded), 0, []
        for _ in range(n):
            code = length = 0
            while (s := self.codes.get((length, code))) is None or not length:
                code, length, at = code << 1 | (bits[at] == "1"), length + 1, at + 1
            extra = int(bits[at : at + s] or "0", 2)
            at += s
            out.append(extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1)
        return out


def _baseline(frame: bytes) -> bool:
    """Whether a frame's header says baseline or extended sequential."""
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF and frame[at + 1] not in (0xDA, 0xC3):
        if frame[at + 1] in (0xC0, 0xC1):
            return True
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return False


def decode_frames(media: bytes, frames: list[tuple[int, int]]) -> np.ndarray:
    """Samples (frames, height, width) of lossless JPEG frames that share one header, or the luminance of baseline ones."""
    if frames and _baseline(media[frames[0][0] : sum(frames[0])]):
        planes = [baseline.luminance(media[at : at + size]) for at, size in frames]
        if len({p.shape for p in planes}) > 1:
            raise ValueError("frames of unlike sizes")
        return np.stack(planes)
    jpeg, coded = None, []
    for at, size in frames:
        f = media[at : at + size]
        if jpeg is None:
            jpeg = _Jpeg(f)
        elif not f.startswith(jpeg.head):
            raise ValueError("frames with unlike headers")
        if f[-2:] != b"\xff\xd9":
            raise ValueError("a frame has no end")
        coded.append(f[len(jpeg.head) : -2].replace(b"\xff\x00", b"\xff"))
    if jpeg is None:
        return np.zeros((0, 0, 0), np.uint8)
    d = jpeg.differences(coded)
    d[:, :, 0] = 128 + np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


def shot_cuts(samples: np.ndarray) -> list[int]:
    """First frames of all shots but the first."""
    n = len(samples)
    if n < 2:
        return []
    flat = (samples.reshape(n, -1) // (256 // BINS)).astype(np.intp)
    hist = np.bincount((flat + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2.0 * flat.shape[1])
    c1, c2 = (np.concatenate([[0.0], np.cumsum(v)]) for v in (diff, diff * diff))
    t = np.arange(len(diff))
    lo = np.maximum(0, t - WINDOW)
    k = np.maximum(1, t - lo)
    mean = (c1[t] - c1[lo]) / k
    sd = np.sqrt(np.maximum(0.0, (c2[t] - c2[lo]) / k - mean * mean))
    cuts, last = [], 0
    for i in np.flatnonzero((diff > mean + SPREAD * sd) & (diff > FLOOR) & (t > 0)):
        if i + 1 - last >= LEAST:
            last = int(i) + 1
            cuts.append(last)
    return cuts


def analyse(media: bytes | None) -> tuple[int | None, bytes | None, list[dict], str | None]:
    """Frames, payload, clip rows and error of a file."""
    try:
        if media is None:
            raise ValueError("no media")
        avi = read_avi(media)
        samples = decode_frames(media, avi["frames"])
        n, fps = len(samples), avi["fps"]
        edges = [0, *shot_cuts(samples), n] if n else []
        clips = [{"clip": i, "start_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        payload = samples.tobytes()
        kept = avi["comment"].partition("payload_bytes=")[2]
        if kept.isdecimal():
            payload = payload[: int(kept)]
        return n, payload, clips, None
    except (ValueError, IndexError, KeyError, OverflowError, struct.error) as e:
        return None, None, [], str(e) or type(e).__name__


#: Rows and bytes that a Python worker holds as output at once.
_ROWS, _BYTES = 512, 8_000_000


def _mapped(df: DataFrame, column: str, added: list[T.StructField], row) -> DataFrame:
    """Columns ``added`` beside all of df's, from ``row(value)``, in small Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in added]
    df = cleared(df, *names)
    schema = T.StructType([*df.schema.fields, *added])
    where = df.columns.index(column)

    def run(batches):
        import pyarrow as pa

        types = [to_arrow_schema(T.StructType(added)).field(i).type for i in range(len(added))]
        for batch in batches:
            first, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                rows.append(row(batch.column(where)[i].as_py()))
                held += sum(len(v) for v in rows[-1] if isinstance(v, bytes))
                if len(rows) >= _ROWS or held >= _BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*batch.schema.names, *names])
                    first, rows, held = i + 1, [], 0

    return df.mapInArrow(run, schema)


def texts_to_avi(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with ``media`` (the AVI file that holds the padded UTF-8 bytes) and ``n_bytes`` (before padding)."""

    def row(text):
        raw = (text or "").encode("utf-8", "surrogatepass")
        return payload_to_avi(pad_payload(raw)), len(raw)

    return _mapped(df, text_col, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], row)


def avi_clips(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with ``frames``, ``payload`` (the samples read back), ``clips`` (timed shots) and ``error``."""
    added = [T.StructField("frames", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("clips", CLIPS), T.StructField("error", T.StringType())]
    return _mapped(df, media_col, added, analyse)


def clip_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each clip of ``avi_clips``."""
    return df.select(*keys, F.inline("clips"))
