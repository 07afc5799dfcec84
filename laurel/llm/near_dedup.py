"""Near-duplicates by a multi-index Hamming join of minhash signatures.

A document is the set of its word shingles. Its signature has `chunks` times 4 symbols of 16
bits, each the low bits of one minimum hash; two sets of similarity s differ in about
(1 - s) of the symbols. Pairs within `2 * chunks - 1` differing symbols are all found: by
the pigeonhole principle one of the chunks then has at most one error, so leaving out each
symbol in turn, as the allowed error, gives a key on which the two agree. For a similarity
of 0.8 and 16 chunks the chance that a linked pair differs in more symbols is below 1e-6.
Candidate pairs are confirmed on the full sets.

Documents with equal sets count as one. Within a key not all pairs are made: first every
member meets the key's centre, the member that shares most keys with others, which joins
most groups. Then the members of a centre that are not yet in its component are compared
with all its members, on the full sets, in pairs of blocks of bounded size. A block gives
only as many links as join its components, so the links grow with the documents. No pair
that shares a key and is not connected already is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, spread_join
from laurel.llm import arrays
from laurel.llm.components import components
from laurel.llm.tables import settled, text_of

SYMBOLS = 4
HOT_LIMIT = 10_000
#: So many shingles and so many documents, about, has each side of a block: what it counts takes a value for each pair.
BLOCK = 400_000
WIDE = 2_000


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted fingerprints of each text's distinct shingles of `size` words, in lower case."""
    data = arrays.LOWER[data]
    begin, end, first = arrays.words(data, at)
    hashes = arrays.word_hashes(data, begin, end)
    rolled = arrays.rolling(hashes, size) if len(hashes) >= size else hashes[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a:b - size + 1])
        elif b > a:
            yield arrays.mixed(arrays.rolling(hashes[a:b], b - a) + np.uint64(b - a))[:1]
        else:
            yield hashes[:0]


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(hashlib.shake_256(b"signature").digest(16 * n), "<u8")
    return values[:n], values[n:] | np.uint64(1)


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """One row of 16-bit symbols for each set; all must hold something."""
    add, times = _constants(symbols)
    flat = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), symbols), np.uint16)
    for i in range(symbols):
        least = np.minimum.reduceat((flat ^ add[i]) * times[i], start)
        out[:, i] = (arrays.mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray, chunks: int) -> np.ndarray:
    """For each signature a key for each chunk and each symbol left out of it."""
    parts = signature.reshape(len(signature), chunks, SYMBOLS).astype(np.uint64)
    keys = []
    for left in range(SYMBOLS):
        key = np.zeros((len(signature), chunks), np.uint64)
        for i in range(SYMBOLS):
            if i != left:
                key = (key << np.uint64(16)) | parts[:, :, i]
        keys.append(key ^ arrays.mixed(np.arange(chunks, dtype=np.uint64) * np.uint64(SYMBOLS) + np.uint64(left + 1)))
    return arrays.mixed(np.stack(keys, axis=2).reshape(len(signature), -1))


def _signed(size: int, symbols: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = arrays.flat(batch.column("text"))
            for lo, hi in arrays.slices(at):
                sets = list(shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], size))
                full = [s for s in sets if len(s)]
                signed = iter(signatures(full, symbols)) if full else iter(())
                rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(signed).tobytes())
                        if len(s) else (0, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo),
                     *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)

    return run


def _keys(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, _ = arrays.flat(batch.column("signature"))
            keys = index_keys(data.view(np.uint16).reshape(batch.num_rows, -1), chunks)
            ids = np.repeat(batch.column("id").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = arrays.flat(batch.column("text"))
            for lo, hi in arrays.slices(at):
                sets = [s.tobytes() for s in shingle_sets(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _near(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most `radius` symbols."""
    for batch in batches:
        if batch.num_rows:
            a, b = (arrays.flat(batch.column(c))[0].view(np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            near = (a != b).sum(axis=1) <= radius
            yield batch.filter(pa.array(near)).select(["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("xa"), batch.column("xb")):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets x shares with each of the sets y."""
    out = np.zeros((len(x), len(y)), np.float32)
    vx, vy = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), list(map(len, x))), np.repeat(np.arange(len(y)), list(map(len, y)))
    common = np.intersect1d(vx, vy)
    if not len(common):
        return out

    def placed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        keep = common[at] == values
        at, rows = at[keep], rows[keep]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order], np.bincount(at, minlength=len(common))

    (ax, rx, nx), (ay, ry, ny) = placed(vx, rx), placed(vy, ry)
    often = nx * ny > 64
    begin_x, begin_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    rare = np.flatnonzero(~often)
    pairs = nx[rare] * ny[rare]
    k = np.repeat(rare, pairs)
    place = np.arange(len(k)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    np.add.at(out, (rx[begin_x[k] + place // ny[k]], ry[begin_y[k] + place % ny[k]]), 1)
    column = np.cumsum(often) - 1
    ux, uy = often[ax], often[ay]
    cx, cy, rx, ry = column[ax[ux]], column[ay[uy]], rx[ux], ry[uy]
    for lo in range(0, int(often.sum()), 2048):  # values that many sets hold: as a product of 0-1 matrices
        parts = []
        for c, r, n in ((cx, rx, len(x)), (cy, ry, len(y))):
            some = slice(*np.searchsorted(c, [lo, lo + 2048]))
            part = np.zeros((n, 2048), np.float32)
            part[r[some], c[some] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _joined(percent: int):
    """Links that connect components within one pair of blocks: a forest of them, not all."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy(zero_copy_only=False)
        ids, label = table.column("a").to_numpy(), table.column("ca").to_numpy()
        sets = [np.frombuffer(b.as_py(), "<u8") for b in table.column("shingles")]
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        out: list[tuple[int, int]] = []
        if len(x) and len(y):
            both = shared_counts([sets[i] for i in x], [sets[i] for i in y]).astype(np.float64)
            size = np.array([len(s) for s in sets], np.float64)
            alike = (100 * both >= percent * (size[x][:, None] + size[y] - both)) & (both > 0)
            i, j = np.nonzero(alike & (label[x][:, None] != label[y]))
            pair = np.stack([label[x[i]], label[y[j]]], axis=1)
            _, first = np.unique(pair, axis=0, return_index=True)
            above: dict[int, int] = {}

            def top(k: int) -> int:
                while above.setdefault(k, k) != k:
                    above[k] = above[above[k]]
                    k = above[k]
                return k

            for f in first.tolist():
                p, q = top(int(pair[f, 0])), top(int(pair[f, 1]))
                if p != q:
                    above[p] = q
                    out.append((int(ids[x[i[f]]]), int(ids[y[j[f]]])))
        columns = list(zip(*out)) if out else [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot_limit: int) -> DataFrame:
    """Links among the pairs (a, b), by full sets; one side of many pairs is dealt out."""
    hot = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")), ["b"], "m", hot_limit)
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    both = spread_join(with_a, sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), ["b"], hot, "a")
    return both.mapInArrow(lambda batches: _linked(batches, percent), "a long, b long")


def links(signed: DataFrame, docs: DataFrame, size: int, percent: int, chunks: int, hot_limit: int = HOT_LIMIT,
          block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Enough confirmed links (a, b) among representatives to connect what is similar."""
    radius = 2 * chunks - 1
    keys = signed.select("id", "signature").mapInArrow(_keys(chunks), "key long, id long")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    hot = settled(hot_keys(sizes, ["key"], "m", hot_limit))
    shared = settled(spread_join(keys, sizes, ["key"], hot, "id"))
    wanted = shared.groupBy("id").agg(F.sum(F.col("m") - 1).alias("met"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    sets = settled(texts.join(wanted.select("id"), "id", "left_semi").mapInArrow(_sets(size), "id long, shingles binary"))

    meets = spread_join(shared, _centres(shared, wanted), ["key"], hot, "id")
    pairs = settled(meets.filter("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct())
    side = signed.select("id", "n", "signature")
    hub = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")), ["b"], "m", hot_limit)
    seen = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
    seen = spread_join(seen, side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")),
                       ["b"], hub, "a")
    seen = seen.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = settled(seen.mapInArrow(lambda batches: _near(batches, radius), "a long, b long"))
    first = settled(_confirmed(near, sets, percent, hot_limit))

    label = settled(components(first))
    stars = label.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(_rest(pairs, label, sets, percent, hub, block, wide))


def _rest(pairs: DataFrame, label: DataFrame, sets: DataFrame, percent: int, hub: DataFrame, block: int, wide: int) -> DataFrame:
    """Links between members of one centre that its star has left in different components.

    Two documents that share a key are members of the key's centre, b. Those that are not
    in the centre's component are compared with all of its members, in blocks of about
    `block` shingles a side and of about `wide` documents.
    """
    own = label.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    centre = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    members = pairs.unionByName(pairs.select(F.col("b").alias("a"), "b").distinct())
    members = members.join(own, "a", "left").withColumn("ca", F.coalesce("ca", "a"))
    members = members.join(sets.select(F.col("id").alias("a"), (F.octet_length("shingles") / 8).alias("n")), "a")
    known = members.select("b").distinct().join(centre, "b", "left").withColumn("cb", F.coalesce("cb", "b"))
    members = settled(spread_join(members, known, ["b"], hub, "a"))
    parts = _dealt(members, hub, block, wide).join(sets.withColumnRenamed("id", "a"), "a")
    return parts.groupBy("b", "i", "j").applyInArrow(_joined(percent), "a long, b long").distinct()


def _dealt(members: DataFrame, hub: DataFrame, block: int, wide: int) -> DataFrame:
    """Both sides of all pairs of blocks: (b, i, j, left, a, ca) of the members (a, b, ca, cb, n)."""
    apart = F.col("ca") != F.col("cb")

    def count(some):
        return F.ceil(F.greatest(F.sum(F.when(some, F.col("n"))) / block, F.count(F.when(some, F.lit(1))) / wide)).cast("int")

    blocks = members.groupBy("b").agg(count(apart).alias("rows"), count(F.lit(True)).alias("columns")).filter("rows > 0")
    members = spread_join(members, blocks, ["b"], hub, "a")

    def of(column: str):
        return F.pmod(F.xxhash64("a"), F.col(column)).cast("int")

    def every(column: str):
        return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

    left = members.filter(apart).select("b", of("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("left"), "a", "ca")
    right = members.select("b", every("rows").alias("i"), of("columns").alias("j"), F.lit(False).alias("left"), "a", "ca")
    return left.unionByName(right)


def _centres(shared: DataFrame, wanted: DataFrame) -> DataFrame:
    best = F.max(F.struct(F.col("met"), (-F.col("id")).alias("minus")))
    return shared.join(wanted, "id").groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.minus")).alias("centre"))


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, chunks: int = 16, hot_limit: int = HOT_LIMIT,
            block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * shared >= percent * all shingles of `size` lower-case
    words; a text with fewer words is one shingle, one without words has none and is linked
    with nothing. component_id is the least doc_id reachable, kept whether it is the row's
    own. A row without doc_id has no component and is kept. Rows with equal doc_id count as
    one document with several texts. Columns beyond doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    rows = settled(rows.mapInArrow(_signed(size, chunks * SYMBOLS), "id long, n long, same binary, signature binary"))
    named = rows.filter("id is not null and n > 0")
    classes = named.groupBy("same").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    classes = settled(classes)
    times = named.groupBy("same").agg(F.count(F.lit(1)).alias("m"))
    member = spread_join(named.select("same", F.col("id").alias("doc")), classes.select("same", "id"), ["same"],
                         hot_keys(times, ["same"], "m", hot_limit), "doc")
    found = links(classes, docs, size, percent, chunks, hot_limit, block, wide)
    equal = member.filter("doc != id").select(F.col("doc").alias("a"), F.col("id").alias("b"))
    label = components(found.unionByName(equal))
    out = rows.select("id", "n").join(label, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def kept(docs: DataFrame, size: int = 5, percent: int = 80, chunks: int = 16) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group, and rows without doc_id; whole repeated rows once."""
    stay = grouped(docs, size, percent, chunks).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(stay, "doc_id", "left_semi").dropDuplicates()
    return named.unionByName(docs.filter("doc_id is null"))
