"""Texts as flat numpy arrays: the bytes of many documents at once, their words, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _random(n: int, name: str) -> np.ndarray:
    return np.frombuffer(hashlib.shake_256(name.encode()).digest(8 * n), dtype="<u8").copy()


BYTES = _random(256, "bytes")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """BASE to the power of 0, 1, ... modulo 2^64."""
    out = np.full(max(n, 1), BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A binary Arrow column as (all bytes, where each row begins and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `size` bytes; one larger row is a range of its own."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows: begin, end, and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    gaps = np.diff(np.append(start, len(data)))
    place = np.arange(start[0], len(data)) - np.repeat(start, gaps)
    inside = place < np.repeat(length, gaps)
    values = BYTES[data[start[0]:]] * powers(int(place.max()) + 1)[place]
    values[~inside] = 0
    return mixed(np.add.reduceat(values, start - start[0]) + length.astype(np.uint64))


def runs_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values; shorter than h by width - 1."""
    if len(h) < width:
        return h[:0]
    out, span = h, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of each `width` consecutive values, width a power of two or below nine."""
    if width & (width - 1):
        p = powers(width)
        n = len(h) - width + 1
        out = np.zeros(max(n, 0), np.uint64)
        for i in range(width):
            out += h[i:i + len(out)] * p[i]
        return mixed(out)
    out, span, p = h, 1, powers(2)[1:]
    while span < width:
        out = out[:-span] + out[span:] * p
        span *= 2
        p = p * p
    return mixed(out)
