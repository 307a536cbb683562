"""Reading of intra-coded JPEG frames (ITU-T T.81): baseline (8 bits, Huffman) and lossless with predictor 1.

Only luminance is returned, the first component: that is what shots are found by. Frames of motion JPEG may leave out
their Huffman tables; the standard's typical ones then hold.
"""

from __future__ import annotations

import re

import numpy as np

# The typical Huffman tables of the standard, as the number of codes of each length 1 to 16 and the first
# symbols in order of their codes. The symbols that are left follow in ascending order.
DC_LUMINANCE = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), ())
DC_CHROMINANCE = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), ())
AC_LUMINANCE = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    (0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82),
)
AC_CHROMINANCE = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    (0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1),
)

_DC_SYMBOLS = list(range(12))
_AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]


class Unreadable(ValueError):
    """The frame is none that this module reads, or is damaged."""


def symbols_of(table: tuple, ac: bool) -> list[int]:
    first = list(table[1])
    return first + sorted(set(_AC_SYMBOLS if ac else _DC_SYMBOLS) - set(first))


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in order: diagonals, taken in turn up and down."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Rows are the basis functions of the cosine transform.
COSINE = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


class _Codes:
    """Length and symbol of the code that begins any 16 bits."""

    def __init__(self, counts, symbols):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        at, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                span = 1 << (16 - length)
                if at + span > 1 << 16 or k >= len(symbols):
                    raise Unreadable("Huffman table")
                self.length[at : at + span], self.symbol[at : at + span] = length, symbols[k]
                at, k = at + span, k + 1
        self.length, self.symbol = self.length.tolist(), self.symbol.tolist()


def _typical() -> dict[tuple[int, int], _Codes]:
    tables = {(0, 0): DC_LUMINANCE, (0, 1): DC_CHROMINANCE, (1, 0): AC_LUMINANCE, (1, 1): AC_CHROMINANCE}
    return {key: _Codes(t[0], symbols_of(t, key[0] == 1)) for key, t in tables.items()}


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, codes: _Codes) -> int:
        v = self.peek()
        n = codes.length[v]
        self.at += n
        if not n or self.at > self.end:
            raise Unreadable("entropy-coded data")
        return codes.symbol[v]

    def extra(self, n: int) -> int:
        """A signed number of n bits."""
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        if self.at > self.end:
            raise Unreadable("entropy-coded data")
        return v if v >> (n - 1) else v - (1 << n) + 1


def _segments(frame: bytes) -> tuple[dict, int]:
    """What the segments before the entropy-coded data say, and where that begins."""
    if frame[:2] != b"\xff\xd8":
        raise Unreadable("no image")
    says: dict = {"quant": {}, "codes": {}, "restart": 0}
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = 1 + (body[k] >> 4)
                says["quant"][body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + 64 * wide], f">u{wide}").astype(np.int64)
                k += 1 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                says["codes"][body[k] >> 4, body[k] & 15] = _Codes(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            says["restart"] = int.from_bytes(body[:2], "big")
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            if marker not in (0xC0, 0xC1, 0xC3) or body[0] != 8 or len(body) < 6 + 3 * body[5]:
                raise Unreadable("process")
            says["process"], says["height"], says["width"] = marker, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            says["components"] = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
        elif marker == 0xDA:
            n = body[0]
            says["scan"] = {body[1 + 2 * c]: (body[2 + 2 * c] >> 4, body[2 + 2 * c] & 15) for c in range(n)}
            says["predictor"], says["shift"] = body[1 + 2 * n], body[3 + 2 * n] & 15
            return says, at
    raise Unreadable("no scan")


def decode(frame: bytes) -> np.ndarray:
    """Luminance samples (height, width) of a frame. Unreadable: progressive, arithmetic or 12-bit frames, several scans,
    lossless frames of more components, another predictor or a point transform, and damaged ones."""
    try:
        says, at = _segments(frame)
        end = frame.find(b"\xff\xd9", at)
        # restart markers stand between parts that are coded each by itself
        parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", frame[at : end if end >= 0 else len(frame)])]
        if not says["height"] or not says["width"] or set(says["scan"]) != {c[0] for c in says["components"]}:
            raise Unreadable("scan")
        return _lossless(says, parts) if says["process"] == 0xC3 else _baseline(says, parts)
    except (IndexError, KeyError, ValueError) as e:
        raise e if isinstance(e, Unreadable) else Unreadable(str(e)) from e


def _lossless(says: dict, parts: list[bytes]) -> np.ndarray:
    if len(says["components"]) != 1 or says["predictor"] != 1 or says["shift"] or says["restart"]:
        raise Unreadable("lossless kind")
    bits, codes = _Bits(parts[0]), says["codes"][0, says["scan"][says["components"][0][0]][0]]
    d = np.array([bits.extra(bits.symbol(codes)) for _ in range(says["height"] * says["width"])], np.int64).reshape(says["height"], says["width"])
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return np.cumsum(d, axis=1).astype(np.uint8)


def _block(bits: _Bits, dc: _Codes, ac: _Codes, before: int) -> list[int]:
    out = [0] * 64
    out[0] = before + bits.extra(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        if s & 15:
            k += s >> 4
            out[k] = bits.extra(s & 15)
            k += 1
        elif s == 0xF0:
            k += 16
        else:
            break
    return out


def _baseline(says: dict, parts: list[bytes]) -> np.ndarray:
    codes = says["codes"] or _typical()
    kinds = says["components"]
    if len(kinds) == 1:  # one component is never interleaved
        kinds = [(kinds[0][0], 1, 1, kinds[0][3])]
    wide, high = max(c[1] for c in kinds), max(c[2] for c in kinds)
    across, down = -(-says["width"] // (8 * wide)), -(-says["height"] // (8 * high))
    name, h, v, q = kinds[0]
    blocks = np.zeros((down * v, across * h, 64), np.int64)
    interval, number, part = says["restart"] or across * down, 0, 0
    while number < across * down:
        bits, before = _Bits(parts[part]), dict.fromkeys((c[0] for c in kinds), 0)
        for m in range(number, min(number + interval, across * down)):
            for c, ch, cv, _ in kinds:
                dc, ac = codes[0, says["scan"][c][0]], codes[1, says["scan"][c][1]]
                for k in range(ch * cv):
                    found = _block(bits, dc, ac, before[c])
                    before[c] = found[0]
                    if c == name:
                        blocks[m // across * v + k // h, m % across * h + k % h] = found
        number, part = number + interval, part + 1
    square = np.zeros_like(blocks)
    square[:, :, ZIGZAG] = blocks * says["quant"][q]
    x = np.einsum("ki,abkl,lj->abij", COSINE, square.reshape(*square.shape[:2], 8, 8).astype(float), COSINE)
    image = np.clip(np.rint(x + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    if (h, v) != (wide, high):
        image = image.repeat(high // v, axis=0).repeat(wide // h, axis=1)
    return image[: says["height"], : says["width"]]
