"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact check.

Windows of every document start at each fourth word. A benchmark item has a window of its
own size, rounded down so that it can start at each of its first four words: wherever the
item stands in a document, one of the four lies under a document window of that size. The
SimHash of a window is the sign of a weighted sum of word fingerprints, taken for all
windows of all sizes from running sums.

The 64 bits are cut into blocks. Two fingerprints within `radius` agree in some block up to
radius // blocks bits, so a table of each block with all those errors made, for the items,
finds every pair within the radius. What is within it is compared exactly: the weighted
similarity of shingles of five words, weighted by how often each occurs. Items too short
for windows are found by equal words.

A place that the end of the document cuts off holds only a part of the item, and a document
shorter than the item is such a part as a whole. For these, each item has its rarest
shingles, so many that what is similar enough holds one of them; the ends of documents with
one of an item's are compared exactly with it.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import arrays
from laurel.llm.tables import id_back, id_of, text_of

STEP = 4
SHINGLE = 5
SHORTEST = 8
#: So many items at most are sent to the executors at once; more take further passes.
ITEMS = 20_000


def weights(length: np.ndarray) -> np.ndarray:
    """Short words are mostly the same ones everywhere, and count less."""
    return np.select([length <= 3, length <= 5], [1, 2], 4).astype(np.int16)


def window_size(words: int) -> int:
    """The largest multiple of STEP that can start at each of the first STEP words; 0 if too short."""
    size = (words - STEP + 1) // STEP * STEP
    return size if size >= SHORTEST else 0


def simhash(votes: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from rows of 64 sums."""
    return np.packbits(votes > 0, axis=1).view(np.uint64).reshape(-1)


def word_votes(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1).astype(np.int16)
    return (2 * bits - 1) * weights(length)[:, None]


def shingle_counts(hashes: np.ndarray) -> dict[int, int]:
    if len(hashes) < SHINGLE:
        rolled = arrays.mixed(arrays.rolling(hashes, len(hashes)) + np.uint64(len(hashes))) if len(hashes) else hashes
    else:
        rolled = arrays.rolling(hashes, SHINGLE)
    values, counts = np.unique(rolled, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist()))


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared weight over total weight."""
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


@dataclass
class Index:
    """The items of one window size: fingerprints, and for each block which of them fit a value."""

    size: int
    item: np.ndarray
    offset: np.ndarray
    prints: np.ndarray
    begins: np.ndarray  # for each block and value, where its list begins
    lists: np.ndarray
    blocks: int

    def near(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, entry) pairs within the radius."""
        width = 64 // self.blocks
        pairs = []
        for b in range(self.blocks):
            value = ((windows >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64) + (b << width)
            count = self.begins[value + 1] - self.begins[value]
            some = np.flatnonzero(count)
            if not len(some):
                continue
            n = count[some]
            window = np.repeat(some, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begins[value[some]], n)
            entry = self.lists[place]
            close = np.bitwise_count(windows[window] ^ self.prints[entry]) <= radius
            pairs.append(window[close] * len(self.prints) + entry[close])
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.unique(np.concatenate(pairs))
        return found // len(self.prints), found % len(self.prints)


def indexed(size: int, entries: list[tuple[int, int, int]], blocks: int, radius: int) -> Index:
    """entries: (item, offset, fingerprint)."""
    width, errors = 64 // blocks, radius // blocks
    item, offset = (np.array([e[i] for e in entries], np.int64) for i in (0, 1))
    prints = np.array([e[2] for e in entries], np.uint64)
    flips = np.array([sum(1 << i for i in c) for k in range(errors + 1) for c in itertools.combinations(range(width), k)],
                     np.int64)
    keys, owner = [], []
    for b in range(blocks):
        value = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
        keys.append(((value[:, None] ^ flips) + (b << width)).reshape(-1))
        owner.append(np.repeat(np.arange(len(prints)), len(flips)))
    key, entry = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(key, kind="stable")
    begins = np.searchsorted(key[order], np.arange((blocks << width) + 1))
    return Index(size, item, offset, prints, begins, entry[order], blocks)


@dataclass
class Benchmark:
    names: list
    counts: list[dict[int, int]]
    length: list[int]
    sizes: list[Index]
    exact: dict[int, dict[int, list[int]]]  # number of words -> fingerprint of them -> items
    rare: np.ndarray  # shingles, in order, and items of which each is among the rarest
    holder: np.ndarray


def rarest(counts: list[dict[int, int]], length: list[int], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, item) in the order of shingles: of each item the rarest, more than it may lack."""
    often = Counter(k for c in counts for k in c)
    pairs = []
    for i, c in enumerate(counts):
        if length[i] > SHINGLE:
            spare = (1 - least) * sum(c.values()) + 1e-9
            for k in sorted(c, key=lambda k: (often[k], k)):
                pairs.append((k, i))
                spare -= c[k]
                if spare < 0:
                    break
    pairs.sort()
    return np.array([k for k, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)


def prepared(items: list[tuple[int, str]], blocks: int, radius: int, least: float = 0.8) -> Benchmark:
    names, counts, length = [], [], []
    entries: dict[int, list] = defaultdict(list)
    exact: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for name, text in items:
        data = arrays.LOWER[np.frombuffer(text.encode(), np.uint8)]
        begin, end, _ = arrays.words(data, np.array([0, len(data)]))
        if not len(begin):
            continue
        hashes = arrays.word_hashes(data, begin, end)
        i, n = len(names), len(hashes)
        names.append(name)
        counts.append(shingle_counts(hashes))
        length.append(n)
        size = window_size(n)
        if not size:
            exact[n][int(arrays.rolling(hashes, n)[0])].append(i)
            continue
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(word_votes(hashes, end - begin), axis=0)])
        prints = simhash(np.stack([sums[o + size] - sums[o] for o in range(STEP)]))
        entries[size] += [(i, o, int(p)) for o, p in enumerate(prints)]
    return Benchmark(names, counts, length, [indexed(s, e, blocks, radius) for s, e in sorted(entries.items())],
                     {n: dict(x) for n, x in exact.items()}, *rarest(counts, length, least))


def at_ends(hashes: np.ndarray, first: np.ndarray, benchmark: Benchmark, least: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, similarity, first word) of similar places that the end of a text cuts off."""
    if not len(benchmark.rare) or len(hashes) < SHINGLE:
        return
    rolled = arrays.rolling(hashes, SHINGLE)
    longest = max(benchmark.length)
    begin = np.maximum(first[:-1], first[1:] - longest + 1)
    size = np.maximum(first[1:] - SHINGLE + 1 - begin, 0)
    place = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    row = np.repeat(np.arange(len(size)), size)
    lo, hi = (np.searchsorted(benchmark.rare, rolled[place], side=side) for side in ("left", "right"))
    n = hi - lo
    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length = np.array(benchmark.length)
    row, item, place = np.repeat(row, n), benchmark.holder[k], np.repeat(place, n)
    near = place > first[row + 1] - length[item]
    for r, i in np.unique(np.stack([row[near], item[near]], axis=1), axis=0).tolist():
        end, counts = int(first[r + 1]), benchmark.counts[i]
        start = max(int(first[r]), end - benchmark.length[i] + 1)
        needed = least * sum(counts.values()) - 1e-9
        if sum(min(m, counts.get(s, 0)) for s, m in shingle_counts(hashes[start:end]).items()) < needed:
            continue
        for word in range(start, end - SHINGLE - int(needed) + 2):
            score = similarity(counts, shingle_counts(hashes[word:end]))
            if score >= least:
                yield r, i, score, word


def found_in(data: np.ndarray, at: np.ndarray, benchmark: Benchmark, radius: int, least: float,
             shift: int = 2) -> list[tuple[int, int, float, int]]:
    """(row, item, similarity, first word) of the best place of each item in each of some texts."""
    data = arrays.LOWER[data]
    begin, end, first = arrays.words(data, at)
    if not len(begin):
        return []
    hashes = arrays.word_hashes(data, begin, end)
    best: dict[tuple[int, int], tuple[float, int]] = {}

    def offer(row: int, item: int, score: float, word: int) -> None:
        old, place = best.get((row, item), (0.0, 0))
        if score >= least and (score > old or score == old and word < place):
            best[row, item] = (score, word)

    for row, item, score, word in at_ends(hashes, first, benchmark, least):
        offer(row, item, score, word - int(first[row]))

    for n, table in benchmark.exact.items():
        if len(hashes) < n:
            continue
        rolled = arrays.rolling(hashes, n)
        for word in np.flatnonzero(np.isin(rolled, np.array(list(table), np.uint64))).tolist():
            row = int(np.searchsorted(first, word, side="right")) - 1
            if word + n <= first[row + 1]:
                for item in table[int(rolled[word])]:
                    offer(row, item, 1.0, word - int(first[row]))
    if benchmark.sizes:
        count = np.diff(first) // STEP
        groups = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(count)), count)
        lead = np.repeat(first[:-1] - groups[:-1] * STEP, count) + np.arange(groups[-1]) * STEP
        sums = np.zeros((len(lead) + 1, 64), np.int32)
        for lo in range(0, len(lead), 16_384):
            place = (lead[lo:lo + 16_384, None] + np.arange(STEP)).reshape(-1)
            votes = word_votes(hashes[place], (end - begin)[place]).reshape(-1, STEP, 64).sum(axis=1)
            sums[lo + 1:lo + 1 + len(votes)] = votes
        np.cumsum(sums, axis=0, out=sums)
        tried: set[tuple[int, int, int]] = set()
        for index in benchmark.sizes:
            q = index.size // STEP
            if len(lead) < q:
                continue
            windows = simhash(sums[q:] - sums[:-q])
            whole = row[q - 1:] == row[:len(row) - q + 1]
            window, entry = index.near(windows, radius)
            keep = whole[window]
            for w, e in zip(window[keep].tolist(), entry[keep].tolist()):
                r, item = int(row[w]), int(index.item[e])
                start = int(lead[w]) - int(index.offset[e])
                n = benchmark.length[item]
                for word in range(start - shift, start + shift + 1):
                    lo, hi = max(word, int(first[r])), min(word + n, int(first[r + 1]))
                    if hi > lo and (r, item, word) not in tried:
                        tried.add((r, item, word))
                        offer(r, item, similarity(benchmark.counts[item], shingle_counts(hashes[lo:hi])), lo - int(first[r]))
    return [(r, i, score, word) for (r, i), (score, word) in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11, blocks: int = 4,
            items: int = ITEMS) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, similarity, start_word, n_words.

    start_word is the first word of the best place; ties take the first. A missing or empty
    text holds nothing, an item without words is held by nothing, and items with equal text
    are each reported; one without item_id as null. Rows with equal doc_id are documents of their own. Columns beyond
    doc_id and text, item_id and text are not read. At most `items` items are collected at a
    time; a larger benchmark takes more passes over the documents.
    """
    wanted = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = wanted.count()
    passes = max(1, -(-total // items))
    rows = docs.select(id_of().alias("id"), text_of().alias("text"))
    schema = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                        ("start_word", pa.int64()), ("n_words", pa.int64())])

    def searched(found: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = prepared(found, blocks, radius, least)
            for batch in batches:
                data, at = arrays.flat(batch.column("text"))
                ids = batch.column("id").to_pylist()
                for lo, hi in arrays.slices(at):
                    held = found_in(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], index, radius, least)
                    if held:
                        out = [(ids[lo + r], index.names[i], s, w, index.length[i]) for r, i, s, w in held]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        return run

    out = None
    for k in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else wanted
        found = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        step = rows.mapInArrow(searched(found), "id long, item_id long, similarity double, start_word long, n_words long")
        out = step if out is None else out.unionByName(step)
    return out.select(id_back("id").alias("doc_id"), *out.columns[1:])


def kept(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 11, blocks: int = 4) -> DataFrame:
    """The rows of docs that hold no item; rows without doc_id are judged by their text."""
    text = F.coalesce("text", F.lit(""))
    held = matches(docs.filter("doc_id is not null"), benchmark, least, radius, blocks).select("doc_id").distinct()
    nameless = docs.filter("doc_id is null").withColumn("_h", F.xxhash64(text))
    bad = matches(nameless.select(F.col("_h").alias("doc_id"), "text"), benchmark, least, radius, blocks)
    bad = bad.select(F.col("doc_id").alias("_h")).distinct()
    return (docs.filter("doc_id is not null").join(held, "doc_id", "left_anti")
            .unionByName(nameless.join(bad, "_h", "left_anti").select(*docs.columns)))
