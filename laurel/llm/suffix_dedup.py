"""Exact substring removal by longest previous factors: bytes of strings that also start earlier.

Text positions are ordered by the string that begins there (a suffix array, cut after the
match length), with the length that neighbours share. A position's longest previous factor
is what it shares with the previous or the next entry in that order that lies earlier in the
text, whichever is longer. Where it reaches the match length, an earlier copy exists: every
later copy goes, the first stays.

No machine holds the suffix array of the corpus. Positions that can match share a
minimiser (see `repeats`), so each bucket orders its own; factors that reach the match
length are found there as in the whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laurel.llm import arrays, repeats
from laurel.llm.tables import id_back

INNER = 32
BYTE_STEPS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def ranks(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each position in the corpus order; equal positions have equal places."""
    by = np.lexsort((at, ids))
    step = np.ones(len(by), np.int64)
    step[1:] = (ids[by[1:]] != ids[by[:-1]]) | (at[by[1:]] != at[by[:-1]])
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(step)
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of `length` bytes that begin at `at`, in order.

    Gives the class of each start (equal strings are one class, numbered in suffix order) and
    how many leading bytes each class shares with the class before it. `data` has eight bytes or more after the last string. Equal strings are found by
    fingerprint and compared; the classes are then sorted eight bytes at a time, and only those
    that are still equal go on.
    """
    inner = 1 << (length.bit_length() - 1)
    rolled = arrays.rolling(arrays.BYTES[data], inner)
    marks = rolled[at] * arrays.BASE + rolled[at + length - inner]
    _, first, of = np.unique(marks, return_index=True, return_inverse=True)
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))

    def key(starts: np.ndarray, depth: int) -> np.ndarray:
        return eight[starts + depth].astype(np.uint64) >> np.uint64(8 * max(0, 8 - (length - depth)))

    if any((key(at, d) != key(at[first[of]], d)).any() for d in range(0, length, 8)):
        first = of = np.arange(len(at))  # a fingerprint of two strings: leave all to the sort
    order, shared = np.arange(len(first)), np.zeros(len(first), np.int64)
    tied, group = np.arange(len(first)), np.zeros(len(first), np.int64)
    for depth in range(0, length, 8):
        if not len(tied):
            break
        k = key(at[first[order[tied]]], depth)
        by = np.lexsort((k, group)) if depth else np.argsort(k, kind="stable")
        order[tied] = order[tied][by]
        unlike = k[by][1:] ^ k[by][:-1]
        within = group[1:] == group[:-1]
        shared[tied[1:][within]] = depth + min(8, length - depth) - np.searchsorted(BYTE_STEPS, unlike[within], "right")
        same = within & (unlike == 0)
        go_on = np.append(False, same) | np.append(same, False)
        group = np.cumsum(np.append(True, ~same))[go_on]
        tied = tied[go_on]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    if len(first) == len(at) and (shared == length).any():
        return (np.cumsum(shared < length) - 1)[number], shared[shared < length]
    return number[of], shared


def shared_with_smaller(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Of each entry: the least `shared` on the way back to the nearest entry of smaller place.

    0 where there is none. Steps of doubling width over running minima, then halving ones, so
    that no order of places makes it quadratic.
    """
    least, common = [np.append(-1, place)], [np.append(0, shared)]
    pos, out = np.arange(len(place)), shared.copy()
    top = np.zeros(len(place), np.int64)
    live, k = np.arange(len(place)), 0

    def step(live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        clear = least[k][pos[live]] >= place[live]
        on, stay = live[clear], live[~clear]
        out[on] = np.minimum(out[on], common[k][pos[on]])
        pos[on] -= 1 << k
        return on, stay

    while len(live):
        live, stay = step(live, k)
        top[stay] = k
        for table in (least, common):
            wider = table[k].copy()
            np.minimum(table[k][1 << k:], table[k][:-(1 << k)], out=wider[1 << k:])
            table.append(wider)
        k += 1
    for k in range(k - 2, -1, -1):
        step(np.flatnonzero(top > k), k)
    return out


def longest_previous_factor(data: np.ndarray, at: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """How long a beginning, `length` at most, each string at `at` shares with one of smaller place.

    The longest is that of the previous or of the next smaller place in suffix order. Of equal
    strings all but the first have one; the first looks among the other classes.
    """
    of, shared = suffix_order(data, at, length)
    least = np.full(len(shared), np.iinfo(np.int64).max)
    np.minimum.at(least, of, place)
    before = shared_with_smaller(least, shared)
    after = shared_with_smaller(least[::-1], np.append(shared[1:], 0)[::-1])[::-1]
    return np.where(place > least[of], length, np.maximum(before, after)[of])


def _places(data: np.ndarray, at: np.ndarray):
    return np.arange(len(data)), np.arange(1, len(data) + 1), at


def _strings(length: int):
    def windows(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join([*payloads, bytes(8)]), np.uint8)
        sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
        count = sizes - length + 1
        begun = np.cumsum(sizes) - sizes
        return data, np.repeat(begun - (np.cumsum(count) - count), count) + np.arange(count.sum())

    return windows


def byte_units(length: int) -> repeats.Units:
    inner = min(INNER, 1 << (length.bit_length() - 1))
    return repeats.Units(
        size=length, inner=inner, places=_places,
        rolled=lambda data, begin, end: arrays.rolling(arrays.BYTES[data], inner) if len(data) >= inner else np.zeros(0, np.uint64),
        packed=lambda data, begin, end, u, v: data[u:v].tobytes(),
        windows=_strings(length), same_document=True)


def _earlier(length: int):
    def earlier(strings, ids, at):
        return longest_previous_factor(*strings, ranks(ids, at), length) >= length

    return earlier


def _digest(keep_text: bool):
    def digest(data, begin, end, first, gone):
        out = []
        edges = np.append(gone, False) & ~np.append(False, gone)
        edges[first[:-1][first[:-1] < len(gone)]] |= gone[first[:-1][first[:-1] < len(gone)]]
        spans = np.concatenate([[0], np.cumsum(edges[:-1])])
        removed = np.concatenate([[0], np.cumsum(gone)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = int(removed[b] - removed[a])
            kept = data[a:b].tobytes() if not n else data[a:b][~gone[a:b]].tobytes()
            row = [b - a, n, int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest()]
            out.append((*row, kept) if keep_text else tuple(row))
        return out

    return digest


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = True,
                   hot_limit: int = repeats.HOT_LIMIT, chunk_bytes: int = repeats.CHUNK_BYTES) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts earlier.

    Earlier is a smaller doc_id, or the same doc_id and a smaller start; strings are judged
    on the input, and never cross documents. Other columns of `docs` are not read. A missing
    or empty text gives zeros; a row without doc_id comes before all others. Rows with equal
    doc_id are judged by start alone. Returns doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, if wanted, the bytes that stay.
    """
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
              ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text
    out = repeats.deduplicated(
        docs, byte_units(length), _earlier(length), _digest(keep_text), pa.schema(fields),
        "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text,
        hot_limit, chunk_bytes)
    return out.select(id_back("id").alias("doc_id"), *out.columns[1:])
