"""Windows of text that occur again, over all documents: what the two substring operators share.

A window is `size` consecutive units (bytes or words) of one document. Consecutive windows
that share their minimiser, the least fingerprint of the short strings inside, form one
piece. Equal windows have equal minimisers, so only pieces whose minimiser occurs twice
can hold a repeated window, and those with one minimiser meet in one bucket.

    documents, dealt to chunks of some MB --> distinct minimisers of each chunk
      --> the ones that occur again, back to their chunks --> pieces, to their buckets
      --> windows compared there --> repeated windows, back to their chunks

The texts are shuffled once, for all three visits. Skew: a chunk sends each distinct piece
once, however many of its documents hold it. A minimiser that occurs in more than
`hot_limit` places is dealt out window by window, so that no bucket gets them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm import arrays
from laurel.llm.tables import id_of, text_of

CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
HOT_LIMIT = 5_000
LONGEST_PIECE = 128

DEALT = "h long, chunk int, row int, start int, units int, id long, payload binary"
REMOVED = "chunk int, row int, start int, units int"


@dataclass(frozen=True)
class Units:
    """How a text divides into units.

    places(data, at) gives (begin, end, first unit of each row); rolled the fingerprints of
    `inner` consecutive units; packed the bytes that stand for a range of units; windows the
    sortable columns of every window in a list of packed strings.
    """

    size: int
    inner: int
    places: Callable
    rolled: Callable
    packed: Callable
    windows: Callable
    same_document: bool


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """(id, text as bytes, chunk), chunk by fingerprint; and how many chunks there are."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    chunks = max(1, -(-(size["b"] or 0) // chunk_bytes), -(-size["n"] // chunk_rows))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return docs.select(id_of().alias("id"), text_of().alias("text"), place.alias("chunk")), chunks


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that does not depend on how they came."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    if len(same):
        text = table.column("text")
        order = np.array(sorted(order.tolist(), key=lambda i: (ids[i], text[i].as_py())))
    return table.take(pa.array(order))


def _pieces(units: Units, data: np.ndarray, at: np.ndarray):
    """All pieces of some rows: what to count, and minimiser, row, first unit within the row, windows, and the unit places."""
    begin, end, first = units.places(data, at)
    rolled = units.rolled(data, begin, end)
    least = arrays.runs_min(rolled, units.size - units.inner + 1)
    if not len(least):
        return None
    n = len(least)
    begins, stop = first[:-1], np.maximum(first[1:] - units.size + 1, first[:-1])  # of each row's whole windows
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[begins[begins < n]] = True
    new[stop[stop < n]] = True
    edge = np.flatnonzero(new)
    parts = -(-np.diff(np.append(edge, n)) // LONGEST_PIECE)
    head = _ranges(edge, parts, LONGEST_PIECE)
    count = np.diff(np.append(head, n))
    row = np.searchsorted(first, head, side="right") - 1
    keep = head < stop[row]
    head, count, row = head[keep], count[keep], row[keep]
    if units.same_document:
        inside = least.copy()
        cut = _ranges(stop, first[1:] - stop)
        inside[cut[cut < n]] = 0
        marks = _occurrences(rolled, inside, units.size - units.inner + 1)
    else:
        marks = least[head]
    return marks, least[head], row, head, count, begin, end, first


def _ranges(start: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """start, start + step, ... of each range, `count` values each, one range after the other."""
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(start, count) + step * inside


def _occurrences(rolled: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """The minimisers of all windows, once for each place: a periodic text has one minimiser in many."""
    pad = np.zeros(width - 1, np.uint64)
    most = ~arrays.runs_min(~np.concatenate([pad, least, pad]), width)
    return rolled[(most == rolled) & (most > 0)]


def _minimisers(units: Units):
    def run(table: pa.Table) -> pa.Table:
        data, at = arrays.flat(table.column("text"))
        found = []
        for lo, hi in arrays.slices(at):
            pieces = _pieces(units, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            if pieces is not None:
                found.append(pieces[0])
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
        chunk = np.full(len(h), table.column("chunk")[0].as_py(), np.int32)
        return pa.table({"h": h.view(np.int64), "chunk": chunk, "n": n.astype(np.int32)})

    return run


def _dealt(units: Units):
    """Pieces that may repeat; one that the chunk has already had is removed at once (units < 0)."""

    def run(texts: pa.Table, again: pa.Table) -> pa.Table:
        out = {k: [] for k in ("h", "row", "start", "units", "id", "payload")}
        if not texts.num_rows or not again.num_rows:
            return pa.table({
                "h": pa.array([], pa.int64()), "chunk": pa.array([], pa.int32()), "row": pa.array([], pa.int32()),
                "start": pa.array([], pa.int32()), "units": pa.array([], pa.int32()), "id": pa.array([], pa.int64()),
                "payload": pa.array([], pa.binary())})
        texts = _in_order(texts)
        ids = texts.column("id").to_numpy()
        wanted = again.column("h").to_numpy()
        order = np.argsort(wanted)
        wanted, hot = wanted[order], again.column("hot").to_numpy(zero_copy_only=False)[order]
        data, at = arrays.flat(texts.column("text"))
        seen: dict[bytes, tuple[int, int]] = {}

        def put(h, row, start, count, doc, payload):
            before = seen.setdefault(payload, (doc, start))
            if before[0] < doc or units.same_document and before < (doc, start):
                h, payload, count = row, None, -count
            for k, v in zip(out, (h, row, start, count, doc, payload)):
                out[k].append(v)

        for lo, hi in arrays.slices(at):
            part = data[at[lo]:at[hi]]
            pieces = _pieces(units, part, at[lo:hi + 1] - at[lo])
            if pieces is None:
                continue
            _, least, row, head, count, begin, end, first = pieces
            key = least.view(np.int64)
            where = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            chosen = np.flatnonzero(wanted[where] == key)
            for i in chosen.tolist():
                r, u, c = int(row[i]), int(head[i]), int(count[i])
                start, doc = u - int(first[r]), int(ids[lo + r])
                if not hot[where[i]]:
                    put(int(key[i]), lo + r, start, c, doc, units.packed(part, begin, end, u, u + c + units.size - 1))
                    continue
                for j in range(c):
                    payload = units.packed(part, begin, end, u + j, u + j + units.size)
                    put(_number(payload), lo + r, start + j, 1, doc, payload)
        chunk = np.full(len(out["h"]), texts.column("chunk")[0].as_py(), np.int32)
        return pa.table({
            "h": pa.array(out["h"], pa.int64()), "chunk": chunk, "row": pa.array(out["row"], pa.int32()),
            "start": pa.array(out["start"], pa.int32()), "units": pa.array(out["units"], pa.int32()),
            "id": pa.array(out["id"], pa.int64()), "payload": pa.array(out["payload"], pa.binary())})

    return run


def _number(payload: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)


def runs_of_equal(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their columns, which of the sorted rows differ from the one before)."""
    by = np.lexsort(columns.T[::-1])
    ordered = columns[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return by, new


def _compared(units: Units, earlier: Callable):
    def run(table: pa.Table) -> pa.Table:
        count = table.column("units").to_numpy()
        h, chunk, row, start, ids = (table.column(k).to_numpy() for k in ("h", "chunk", "row", "start", "id"))
        done = np.flatnonzero(count < 0)
        out = [np.stack([chunk[done], row[done], start[done], -count[done]], axis=1).astype(np.int32)]
        live = np.flatnonzero(count > 0)
        live = live[np.argsort(h[live], kind="stable")]
        total = np.cumsum(count[live])
        first = 0
        while first < len(live):  # whole minimisers at a time, some 100,000 windows
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + 100_000)))
            last = int(np.searchsorted(h[live], h[live[last - 1]], side="right")) if last < len(live) else last
            part = live[first:last]
            first = last
            if len(part) < 2 and not units.same_document:
                continue
            columns = units.windows([table.column("payload")[int(i)].as_py() for i in part])
            piece = np.repeat(part, count[part])
            begun = np.cumsum(count[part]) - count[part]
            inside = np.arange(len(piece)) - np.repeat(begun, count[part])
            at = start[piece] + inside
            gone = earlier(columns, ids[piece], at)
            if not gone.any():
                continue
            edge = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & np.append(False, piece[1:] == piece[:-1])))
            stop = np.flatnonzero(gone & ~(np.append(gone[1:], False) & np.append(piece[1:] == piece[:-1], False)))
            out.append(np.stack([chunk[piece[edge]], row[piece[edge]], at[edge], stop - edge + 1], axis=1).astype(np.int32))
        all_ = np.concatenate(out)
        return pa.table({k: np.ascontiguousarray(all_[:, i]) for i, k in enumerate(("chunk", "row", "start", "units"))})

    return run


def _covered(units: Units, digest: Callable, schema: pa.Schema):
    """For each document the units that removed windows cover, handed to `digest`."""

    def run(texts: pa.Table, removed: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        texts = _in_order(texts)
        data, at = arrays.flat(texts.column("text"))
        row, start, count = (removed.column(k).to_numpy() for k in ("row", "start", "units"))
        by = np.argsort(row, kind="stable")
        row, start, count = row[by], start[by].astype(np.int64), count[by].astype(np.int64)
        rows = []
        for lo, hi in arrays.slices(at):
            part = data[at[lo]:at[hi]]
            begin, end, first = units.places(part, at[lo:hi + 1] - at[lo])
            a, b = np.searchsorted(row, [lo, hi])
            head = first[row[a:b] - lo] + start[a:b]
            change = np.zeros(len(begin) + 1, np.int64)
            np.add.at(change, head, 1)
            np.add.at(change, head + count[a:b] + units.size - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            rows += digest(part, begin, end, first, gone)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
        return pa.Table.from_arrays([texts.column("id").combine_chunks(), *columns], schema=schema)

    return run


def deduplicated(docs: DataFrame, units: Units, earlier: Callable, digest: Callable, schema: pa.Schema,
                 spark_schema: str, hot_limit: int = HOT_LIMIT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document: its id and what `digest` says of its removed units."""
    texts, chunks = chunked(docs, chunk_bytes)
    by_chunk = texts.groupBy("chunk")
    found = by_chunk.applyInArrow(_minimisers(units), "h long, chunk int, n int")
    times = F.sum("n").over(Window.partitionBy("h"))
    again = (found.withColumn("times", times).filter("times > 1")
             .select("chunk", "h", (F.col("times") > hot_limit).alias("hot")))
    dealt = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(_dealt(units), DEALT)
    bucket = F.pmod(F.xxhash64("h"), F.lit(chunks)).cast("int")
    compared = (dealt.withColumn("bucket", bucket).groupBy("bucket")
                .applyInArrow(_compared(units, earlier), REMOVED))
    return by_chunk.cogroup(compared.groupBy("chunk")).applyInArrow(_covered(units, digest, schema), spark_schema)

