"""The luminance of baseline JPEG frames (8 bits, sequential, Huffman-coded), as motion-JPEG files hold them.

Frames of one or three components are read, with any sampling in which luminance is the finest, with
restart intervals, and without Huffman tables of their own (then the standard's hold, as is usual
in AVI files).  Anything that is damaged or of another kind raises ``ValueError`` or ``IndexError``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The standard's Huffman tables (counts by code length, symbols) and the zigzag order.
DC_LUMINANCE = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMINANCE = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMINANCE_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_LUMINANCE_SYMBOLS = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07,
    0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0,
    0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28,
    0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49,
    0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69,
    0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89,
    0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7,
    0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5,
    0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
    0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
    0xF9, 0xFA,
]
AC_CHROMINANCE_COUNTS = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
AC_CHROMINANCE_SYMBOLS = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71,
    0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0,
    0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26,
    0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48,
    0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68,
    0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87,
    0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5,
    0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
    0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
    0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
    0xF9, 0xFA,
]
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10,
    17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34,
    27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36,
    29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46,
    53, 60, 61, 54, 47, 55, 62, 63,
]
AC_LUMINANCE, AC_CHROMINANCE = (AC_LUMINANCE_COUNTS, AC_LUMINANCE_SYMBOLS), (AC_CHROMINANCE_COUNTS, AC_CHROMINANCE_SYMBOLS)

_K = np.arange(8)
_COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) / 2 * np.where(_K[:, None] == 0, np.sqrt(0.5), 1.0)


def code_lookup(counts, symbols) -> list[tuple[int, int]]:
    """For each 16 bits the length of the code that they begin with, and its symbol; length 0 where there is none."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            if first >= 65536:
                raise ValueError("broken Huffman table")
            out[first : first + (1 << (16 - length))] = [(length, symbols[k])] * (1 << (16 - length))
            code, k = code + 1, k + 1
        code <<= 1
    return out[:65536]


_STANDARD: dict[int, list[tuple[int, int]]] = {}


def _standard() -> dict[int, list[tuple[int, int]]]:
    if not _STANDARD:
        _STANDARD.update({0x00: code_lookup(*DC_LUMINANCE), 0x01: code_lookup(*DC_CHROMINANCE), 0x10: code_lookup(*AC_LUMINANCE), 0x11: code_lookup(*AC_CHROMINANCE)})
    return _STANDARD


@dataclass
class Header:
    width: int = 0
    height: int = 0
    interval: int = 0
    parts: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # id: across, down, quantization table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    body: int = 0


def read_header(frame: bytes) -> Header:
    h, at = Header(codes=dict(_standard())), 2
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("broken JPEG header")
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 129 if wide else 65], ">u2" if wide else np.uint8)
                if len(values) != 64:
                    raise ValueError("broken quantization table")
                h.quantization[body[0] & 15] = values.astype(float)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                h.codes[body[0]] = code_lookup(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            bits, h.height, h.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3) or not h.width or not h.height:
                raise ValueError("only 8-bit frames of one or three components are read")
            h.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif marker == 0xDD:
            h.interval = int.from_bytes(body[:2], "big")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            h.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
            h.body = at
            break
    if not h.parts or any(i not in h.parts for i, _, _ in h.scan):
        raise ValueError("no frame header")
    return h


class _Bits:
    """The coded bits between two restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at > len(self.data) + 4:
                raise ValueError("a frame ends early")
            self.held = (self.held << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\xff"), "big")) & (1 << 96) - 1
            self.at, self.n = self.at + 4, self.n + 32

    def symbol(self, codes: list[tuple[int, int]]) -> int:
        self.need(16)
        length, symbol = codes[self.held >> (self.n - 16) & 0xFFFF]
        if not length:
            raise ValueError("no such code")
        self.n -= length
        return symbol

    def number(self, size: int) -> int:
        if not size:
            return 0
        self.need(size)
        self.n -= size
        value = self.held >> self.n & (1 << size) - 1
        return value if value >> (size - 1) else value - (1 << size) + 1


def luminance(frame: bytes) -> np.ndarray:
    """The first component's samples (height, width)."""
    h = read_header(frame)
    first = next(iter(h.parts))
    across, down, table = h.parts[first]
    if (across, down) != (max(p[0] for p in h.parts.values()), max(p[1] for p in h.parts.values())) or not 0 < across <= 4 or not 0 < down <= 4:
        raise ValueError("luminance is not the finest component")
    if first not in [i for i, _, _ in h.scan]:
        raise ValueError("the first scan has no luminance")
    if len(h.scan) == 1:  # a scan of one component holds its blocks row by row, whatever the sampling
        wide, high = -(-h.width // 8), -(-h.height // 8)
        plan, units_wide, units = [(first, *h.scan[0][1:], 1, 1)], wide, wide * high
        across = down = 1
    else:
        units_wide, units_high = -(-h.width // (8 * across)), -(-h.height // (8 * down))
        wide, high, units = units_wide * across, units_high * down, units_wide * units_high
        plan = [(i, dc, ac, *h.parts[i][:2]) for i, dc, ac in h.scan]
    coded = frame[h.body :]
    if units > 8 * len(coded):
        raise ValueError("a frame ends early")
    sections, start, k = [], 0, coded.find(b"\xff")
    while k >= 0 and k + 1 < len(coded):
        mark = coded[k + 1]
        if 0xD0 <= mark <= 0xD7:
            sections.append(coded[start:k])
            start = k + 2
        elif mark not in (0, 0xFF):
            break
        k = coded.find(b"\xff", k + (1 if mark == 0xFF else 2))
    sections.append(coded[start : k if k >= 0 else len(coded)])
    blocks = np.zeros((high * wide, 64))
    done = 0
    for section in sections:
        bits, before = _Bits(section.replace(b"\xff\x00", b"\xff")), dict.fromkeys(h.parts, 0)
        until = min(units, done + h.interval) if h.interval else units
        while done < until:
            for part, dc, ac, n_across, n_down in plan:
                for block in range(n_across * n_down):
                    size = bits.symbol(h.codes[dc])
                    if size > 15:
                        raise ValueError("broken coefficient")
                    before[part] += bits.number(size)
                    values, at = [(0, before[part])], 1
                    while at < 64:
                        code = bits.symbol(h.codes[ac])
                        run, size = code >> 4, code & 15
                        if not size:
                            if run != 15:
                                break
                            at += 16
                            continue
                        at += run
                        values.append((ZIGZAG[at], bits.number(size)))
                        at += 1
                    if part == first:
                        row = done // units_wide * down + block // across
                        column = done % units_wide * across + block % across
                        for place, value in values:
                            blocks[row * wide + column, place] = value
            done += 1
    if done < units:
        raise ValueError("a frame ends early")
    quantization = np.empty(64)
    quantization[ZIGZAG] = h.quantization[table]
    samples = _COSINES.T @ (blocks * quantization).reshape(-1, 8, 8) @ _COSINES + 128
    plane = samples.reshape(high, wide, 8, 8).transpose(0, 2, 1, 3).reshape(high * 8, wide * 8)
    return np.clip(np.rint(plane), 0, 255).astype(np.uint8)[: h.height, : h.width]
