"""CRC-32 (the reflected polynomial of zip and Ethernet) of many byte spans at once, from a position table.

CRC-32 is linear over exclusive or once the effect of a span's length is taken out: a byte contributes what it and the
distance to the end of its span say, whatever the other bytes are. The contributions are computed once for DISTANCES
distances and 256 bytes; a span is the exclusive or of its bytes' entries (bitwise_xor.reduceat over all spans) and of
a constant for its length. A longer span is cut into blocks of DISTANCES bytes counted from its end: each block is
folded by the table, moved over the bytes behind it, and the blocks of a span are folded in turn.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320
#: Distances from the end of a span that the table holds.
DISTANCES = 64
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The remainder of each byte by itself."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & np.uint32(1), (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


def _moved(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Remainders after one more zero byte."""
    return table[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _position_table() -> np.ndarray:
    """(distance, byte): what a byte contributes that has so many bytes behind it."""
    byte = _byte_table()
    rows = [byte]
    for _ in range(DISTANCES - 1):
        rows.append(_moved(rows[-1], byte))
    return np.stack(rows)


def _jumps(bits: int = 40) -> list[np.ndarray]:
    """For each k, (4, 256) tables that move a remainder over 2 ** k zero bytes, by its four bytes."""
    byte = _byte_table()
    values = np.arange(256, dtype=np.uint32)
    out = [np.stack([_moved(values << np.uint32(8 * at), byte) for at in range(4)])]
    for _ in range(bits - 1):
        out.append(np.stack([_jump(out[-1][at], out[-1]) for at in range(4)]))
    return out


def _jump(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


POSITIONS = _position_table()
JUMPS = _jumps()


def moved(remainders: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each remainder after so many more zero bytes."""
    out = remainders.astype(np.uint32).copy()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero(zeros >> k & 1)
        out[at] = _jump(out[at], JUMPS[k])
    return out


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes: the first remainder, all ones, moved over them and inverted."""
    different, at = np.unique(lengths, return_inverse=True)
    return (moved(np.full(len(different), _ONES), different) ^ _ONES)[at]


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Exclusive or of the table's entries of each span of 1 to DISTANCES bytes."""
    size = end - start
    first = np.cumsum(size) - size
    back = np.repeat(first + size, size) - np.arange(int(size.sum())) - 1
    byte = data[np.repeat(end, size) - 1 - back]
    return np.bitwise_xor.reduceat(POSITIONS.ravel()[back * 256 + byte], first)


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] of each span; data are bytes."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    short = np.flatnonzero((size > 0) & (size <= DISTANCES))
    if len(short):
        out[short] = _folded(data, start[short], end[short])
    long = np.flatnonzero(size > DISTANCES)
    if len(long):
        blocks = -(-size[long] // DISTANCES)
        first = np.cumsum(blocks) - blocks
        # of its span, and how many whole blocks are behind it
        of, behind = np.repeat(long, blocks), np.repeat(first + blocks, blocks) - np.arange(int(blocks.sum())) - 1
        to = end[of] - behind * DISTANCES
        part = _folded(data, np.maximum(start[of], to - DISTANCES), to)
        out[long] = np.bitwise_xor.reduceat(moved(part, behind * DISTANCES), first)
    return out ^ length_constants(size)
