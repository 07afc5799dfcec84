"""Repeated word windows by super-k-mers: remove words of windows an earlier document has.

Consecutive windows with the same minimiser, the least fingerprint of the five-word strings
inside, travel as one packed string to its bucket. There the windows are sorted, word for
word, and runs of equal ones show which documents hold each (see `repeats`).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from laurel.llm import arrays, repeats
from laurel.llm.tables import id_back

INNER = 5


def first_document(columns: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least id, number of occurrences) of the window at each row."""
    by, new = repeats.runs_of_equal(columns)
    head = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least = np.empty(len(by), np.int64)
    times = np.empty(len(by), np.int64)
    least[by] = np.minimum.reduceat(ids[by], head)[run]
    times[by] = np.diff(np.append(head, len(by)))[run]
    return least, times


def _windows(size: int):
    def windows(payloads: list[bytes]) -> np.ndarray:
        number: dict[bytes, int] = {}
        out = []
        for payload in payloads:
            ids = np.fromiter((number.setdefault(w, len(number)) for w in payload.split()), np.int32)
            out.append(np.lib.stride_tricks.sliding_window_view(ids, size))
        return np.concatenate(out)

    return windows


def word_units(size: int) -> repeats.Units:
    inner = min(INNER, size)
    return repeats.Units(
        size=size, inner=inner, places=arrays.words,
        rolled=lambda data, begin, end: arrays.rolling(arrays.word_hashes(data, begin, end), inner),
        packed=lambda data, begin, end, u, v: b" ".join(data[begin[u]:end[v - 1]].tobytes().split()),
        windows=_windows(size), same_document=False)


def _earlier(columns, ids, at):
    return first_document(columns, ids)[0] < ids


def _digest(keep_text: bool):
    def digest(data, begin, end, first, gone):
        out = []
        lost = np.concatenate([[0], np.cumsum(gone)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = int(lost[b] - lost[a])
            kept = b""
            if b > a + n:
                kept = data[begin[a]:end[b - 1]].tobytes().split()
                kept = b" ".join([w for w, g in zip(kept, gone[a:b].tolist()) if not g] if n else kept)
            row = (b - a, n, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept) if keep_text else row)
        return out

    return digest


def remove_windows(docs: DataFrame, size: int = 13, keep_text: bool = True,
                   hot_limit: int = repeats.HOT_LIMIT, chunk_bytes: int = repeats.CHUNK_BYTES) -> DataFrame:
    """Remove each word covered by `size` consecutive words that a smaller doc_id also has.

    Words are runs of anything but ASCII white space, compared unchanged; windows are judged
    on the input. Other columns of `docs` are not read. A missing or empty text has no words;
    a row without doc_id comes before all others; rows with equal doc_id never remove from
    each other. Returns doc_id, n_words, n_removed, kept_sha256 and, if wanted, the words
    that stay.
    """
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
              ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text
    out = repeats.deduplicated(
        docs, word_units(size), _earlier, _digest(keep_text), pa.schema(fields),
        "id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * keep_text,
        hot_limit, chunk_bytes)
    return out.select(id_back("id").alias("doc_id"), *out.columns[1:])
