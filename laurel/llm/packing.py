"""Packing of token ids into sequences of fixed length, by non-negative least squares.

Each task packs the documents of its own part of the input; nothing is shuffled. A document
longer than a window gives whole windows first; the rests wait in bins by length. When
enough wait, the histogram of the bins is cut into `levels` length classes, all shallow
combinations of class lengths (up to `depth` pieces) that fill a window closely are listed,
and non-negative least squares finds how often to use each so that together they use up the
histogram. The rounded counts are packed; what the recipe leaves over is packed greedily,
longest first, and a piece that does not fit is cut, which the format allows. At the end of
a task the last partial sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import id_of

SCHEMA = ("id long, has_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")
MEMO_ENTRIES = 300_000
_tokenisers: dict[tuple, dict] = {}


class _Whole(Exception):
    """The text has to be encoded as a whole."""


class ByteBpe(dict):
    """Ids of a byte-level BPE vocabulary; as a dict, from words met before to their ids.

    Before a single space between two other characters that are no white space, such a
    vocabulary always begins a new token, so a text is the sequence of its space-led words,
    each on its own. Texts with longer runs of white space around spaces are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Whole
        ids = self[word] = self._ids(" " + word)
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if any(s in text for s in self.special):
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *words = text.split(" ")
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if not words or not first or first[-1].isspace():
            return self._ids(text)
        try:
            return self._ids(first) + b"".join(map(self.__getitem__, words))
        except _Whole:
            return self._ids(text)


def tokeniser(json_path: str | None, ranks_path: str | None, pattern: str | None) -> ByteBpe:
    """The tokeniser of these files, loaded once in each worker; by default the public 50k vocabulary."""
    key = (json_path, ranks_path, pattern)
    if key not in _tokenisers:
        import public_tokenizers as public

        _tokenisers[key] = ByteBpe(json_path or public.path("byte_bpe_50k.json"),
                                   ranks_path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN)
    return _tokenisers[key]


def combinations(lengths: list[int], window: int, depth: int, slack: int) -> list[tuple[int, ...]]:
    """Multisets of up to `depth` lengths whose sum lies in [window - slack, window]."""
    return [c for k in range(1, depth + 1) for c in itertools.combinations_with_replacement(lengths, k)
            if window - slack <= sum(c) <= window]


def nonnegative(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that nearly minimises |a x - b|, by accelerated projected gradients."""
    x = y = np.zeros(a.shape[1])
    square = a.T @ a
    right, rate, t = a.T @ b, 1 / max(np.linalg.norm(square, 2), 1e-9), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * (square @ y - right))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def recipe(histogram: np.ndarray, window: int, levels: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to use which combination of length classes; class k holds lengths up to k * window / levels."""
    used = [k for k in range(1, levels + 1) if histogram[k]]
    found = combinations(used, levels, depth, max(1, levels // 16)) if used else []
    if not found:
        return []
    a = np.zeros((len(used), len(found)))
    for j, c in enumerate(found):
        for k in c:
            a[used.index(k), j] += 1
    counts = np.floor(nonnegative(a, histogram[used].astype(float)) + 0.5).astype(int)
    return [(c, n) for c, n in zip(found, counts.tolist()) if n > 0]


def pack_rests(rests: list[tuple[int, int]], window: int, levels: int, depth: int) -> tuple[list, list]:
    """(sequences, what is left): rests are (length below window, key); cuts (length, key, taken) fill a sequence.

    A sequence is a list of (key, tokens). A rest that is only partly used goes back to be used first.
    """
    step = window // levels
    bins: dict[int, deque] = {k: deque() for k in range(1, levels + 1)}
    for length, key in rests:
        bins[-(-length // step)].append((length, key))
    sequences = []

    def fill(sequence: list, room: int) -> int:
        """Greedy: the longest rests first; the last one is cut to fit."""
        for k in range(levels, 0, -1):
            while bins[k] and room:
                length, key = bins[k].popleft()
                take = min(length, room)
                sequence.append((key, take))
                room -= take
                if take < length:
                    left = length - take
                    bins[-(-left // step)].appendleft((left, key))
        return room

    for combination, times in recipe(np.array([0] + [len(bins[k]) for k in range(1, levels + 1)]), window, levels, depth):
        for _ in range(times):
            need = {k: combination.count(k) for k in set(combination)}
            if any(len(bins[k]) < n for k, n in need.items()):
                break
            sequence, room = [], window
            for k in combination:
                length, key = bins[k].popleft()
                sequence.append((key, length))
                room -= length
            sequences.append((sequence, room))
    done = []
    for sequence, room in sequences:
        if room:
            smallest = next((k for k in range(1, levels + 1) if bins[k]), None)
            while room and smallest:
                length, key = bins[smallest].popleft()
                take = min(length, room)
                sequence.append((key, take))
                room -= take
                if take < length:
                    left = length - take
                    bins[-(-left // step)].appendleft((left, key))
                smallest = next((k for k in range(1, levels + 1) if bins[k]), None)
        done.append((sequence, room))
    total = sum(length for b in bins.values() for length, _ in b)
    while total >= window:
        sequence = []
        total -= window - fill(sequence, window)
        done.append((sequence, 0))
    left = [x for k in range(levels, 0, -1) for x in bins[k]]
    full = [s for s, room in done if not room]
    left += [(n, key) for s, room in done if room for key, n in s]
    return full, left


class Packer:
    """Packs a stream of documents; rows come out as sequences close."""

    def __init__(self, window: int, levels: int, depth: int, wait: int, first_sequence: int):
        self.window, self.levels, self.depth, self.wait = window, levels, depth, wait
        self.sequence = first_sequence
        self.docs: dict[int, list] = {}  # key -> [id, has_id, ids, next start]
        self.rests: list[tuple[int, int]] = []
        self.waiting = 0
        self.keys = itertools.count()
        self.out: list[tuple] = []

    def _piece(self, key: int, take: int, offset: int) -> None:
        doc = self.docs[key]
        ident, has_id, ids, start = doc
        piece = ids[4 * start:4 * (start + take)]
        self.out.append((ident, has_id, start, take, zlib.crc32(piece), len(ids) // 4, self.sequence, offset))
        doc[3] += take
        if 4 * doc[3] == len(ids):
            del self.docs[key]

    def add(self, ident: int, has_id: bool, ids: bytes) -> None:
        key, n = next(self.keys), len(ids) // 4
        self.docs[key] = [ident, has_id, ids, 0]
        for _ in range(n // self.window):
            self._piece(key, self.window, 0)
            self.sequence += 1
        if n % self.window:
            self.rests.append((n % self.window, key))
            self.waiting += n % self.window
        if len(self.rests) >= self.wait:
            self.flush()

    def flush(self) -> None:
        full, rests = pack_rests(self.rests, self.window, self.levels, self.depth)
        for sequence in full:
            offset = 0
            for key, take in sequence:
                self._piece(key, take, offset)
                offset += take
            self.sequence += 1
        merged: dict[int, int] = {}
        for n, key in rests:
            merged[key] = merged.get(key, 0) + n
        self.rests = [(n, key) for key, n in merged.items()]

    def close(self) -> None:
        """Everything out; the last tokens in sequences whose lengths are powers of two."""
        self.flush()
        left = deque((key, n) for n, key in self.rests)
        total = sum(n for _, n in left)
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            offset = 0
            while offset < size:
                key, n = left.popleft()
                take = min(n, size - offset)
                self._piece(key, take, offset)
                offset += take
                if take < n:
                    left.appendleft((key, n - take))
            total -= size
            self.sequence += 1
        self.rests = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, levels: int = 32, depth: int = 3, wait: int = 2048,
         json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then `end_id`; a missing or empty text has
    only `end_id`. Each id lies in one piece, the pieces of a sequence follow each other
    without gaps, and every sequence has `window` ids or a power of two. A missing doc_id
    stays missing. Rows with equal doc_id are documents of their own. Other columns are not
    read. An empty table gives no rows. sequence_id holds the number of the task that packed
    it above the lower 32 bits.
    """
    if window % levels or window & (window - 1):
        raise ValueError("window must be a power of two, and levels divide it")
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("id", pa.int64()), ("has_id", pa.bool_())] + [
        (k, pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokeniser(json_path, ranks_path, pattern)
        packer = Packer(window, levels, depth, wait, TaskContext.get().partitionId() << 32)
        for batch in batches:
            ids, has = batch.column("id").to_pylist(), batch.column("has_id").to_pylist()
            text = batch.column("text")
            for i in range(batch.num_rows):
                packer.add(ids[i], has[i], words.encode(text[i].as_py()) + end)
                if len(packer.out) >= 20_000:
                    yield table(packer.taken())
        packer.close()
        if packer.out:
            yield table(packer.taken())

    rows = docs.select(id_of().alias("id"), F.col("doc_id").isNotNull().alias("has_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(run, SCHEMA)
    return out.select(F.when(F.col("has_id"), F.col("id")).alias("doc_id"), *out.columns[2:])
