"""Quality scores: kernel ridge by random Fourier features, calibrated by isotonic regression.

A text gives a vector of statistics. Random cosines of the standardised vector approximate
a Gaussian kernel, so ridge regression on them is kernel ridge. Every partition sums its
part of the normal equations; the sums are added by Spark, for each fold, and only the
small totals reach the driver. Scores of each fold by the equations of the others are then
counted in bins, and pooling adjacent violators makes the calibration curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import arrays
from laurel.llm.learning import SAMPLE, labelled, remainder
from laurel.llm.tables import settled, text_of

FEATURES = 300
FOLDS = 5
BINS = 1000


def _class(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


CLASSES = np.stack([
    _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58)), _class(b"#*$%&|<>"), _class(b"!?"),
    _class(b".,;:"), _class(b"\"'()-_/@=+[]{}\\^~`"), _class(b"\n"), _class(range(128, 192))], axis=0)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: lengths, character classes, repetition, word endings."""
    begin, end, first = arrays.words(data, at)
    hashes = arrays.word_hashes(data, begin, end)
    folded = arrays.word_hashes(arrays.LOWER[data], begin, end)
    size = np.concatenate([[0], np.cumsum(end - begin)])
    kinds = np.zeros((len(CLASSES), len(data) + 1))
    for k, table in enumerate(CLASSES):
        np.cumsum(table[data], out=kinds[k, 1:])
    marks = np.zeros(256, bool)
    marks[list(b"#*$%&!?|<>=+~^")] = True
    odd = np.concatenate([[0], np.cumsum(marks[data[end - 1]])]) if len(end) else np.zeros(1)
    lone = np.concatenate([[0], np.cumsum((end - begin == 1) & marks[data[begin]])]) if len(end) else np.zeros(1)
    three = arrays.rolling(folded, 3) if len(folded) >= 3 else folded[:0]
    rows = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        lo, hi = int(at[i]), int(at[i + 1])
        n, chars = b - a, max(1, hi - lo)
        share = (kinds[:, hi] - kinds[:, lo]) / chars
        if n:
            lengths = end[a:b] - begin[a:b]
            _, times = np.unique(folded[a:b], return_counts=True)
            p = times / n
            distinct, top = len(times) / n, (times.max() - 1) / n
            entropy = -(p * np.log(p)).sum() / np.log(n) if n > 1 else 1.0
            same = float((hashes[a + 1:b] == hashes[a:b - 1]).mean()) if n > 1 else 0.0
            windows = three[a:b - 2]
            fresh = len(np.unique(windows)) / len(windows) if len(windows) else 1.0
            mean, spread = (size[b] - size[a]) / n, float(lengths.std())
            rows.append([np.log1p(n), mean, spread, distinct, top, entropy, same, fresh, (odd[b] - odd[a]) / n,
                         (lone[b] - lone[a]) / n, *share, np.log1p(n / (1 + kinds[7, hi] - kinds[7, lo]))])
        else:
            rows.append([0.0] * 8 + [0.0, 0.0, *share, 0.0])
    return np.array(rows, float).reshape(len(at) - 1, 11 + len(CLASSES))


@dataclass(frozen=True)
class Cosines:
    """Random Fourier features of standardised statistics."""

    mean: np.ndarray
    width: np.ndarray
    turns: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.width, -6, 6)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turns + self.shift)
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)


def cosines(mean: np.ndarray, width: np.ndarray, features: int, scale: float, seed: int) -> Cosines:
    random = np.random.default_rng(seed)
    turns = random.normal(0, 1 / scale, (len(mean), features))
    return Cosines(mean, np.maximum(width, 1e-3), turns, random.uniform(0, 2 * np.pi, features))


@dataclass(frozen=True)
class Model:
    waves: Cosines
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.clip(np.interp(self.waves(x) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of y over x that never fall, by pooling adjacent violators: (knots, levels).

    Each x counts half a row of the overall mean besides its own, so that few rows alone never
    make a certain score. That comes before pooling: afterwards it would bend the curve down.
    """
    mean = total.sum() / n.sum() if n.sum() else 0.0
    pools: list[list[float]] = []
    for value, count, y in sorted(zip(x.tolist(), n.tolist(), total.tolist())):
        pools.append([value * (count + 0.5), count + 0.5, y + 0.5 * mean])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([s / c for s, c, _ in pools]), np.array([y / c for _, c, y in pools])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = arrays.flat(batch.column("text"))
        rows = [statistics(data[at[a]:at[b]], at[a:b + 1] - at[a]) for a, b in arrays.slices(at)]
        x = np.concatenate(rows) if rows else np.zeros((0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.tobytes() for r in x], pa.binary()), batch.column("label"), batch.column("fold")],
            ["x", "label", "fold"])


def _vectors(batch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(batch.num_rows, -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch)
            part = np.stack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([r.tobytes() for r in total], pa.binary())],
                                         ["row", "sums"])


def _equations(waves: Cosines):
    """Each partition's sums of the normal equations, a row of the matrix at a time, for each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, y = waves(_vectors(batch)), batch.column("label").to_numpy()
            fold = batch.column("fold").to_numpy() % FOLDS
            for f in np.unique(fold).tolist():
                part = z[fold == f]
                sums = np.concatenate([part.T @ part, part.T @ y[fold == f][:, None]], axis=1)
                total[f] = total[f] + sums if f in total else sums
        for f, sums in total.items():
            rows = [(f * 10_000 + i, r.tobytes()) for i, r in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["row", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(b) for b in table.column("sums").to_pylist()]
    return pa.table({"row": pa.array([table.column("row")[0].as_py()], pa.int64()),
                     "sums": pa.array([np.sum(rows, axis=0).tobytes()], pa.binary())})


def _summed(rows: DataFrame, partial) -> dict[int, np.ndarray]:
    sums = rows.mapInArrow(partial, "row long, sums binary").groupBy("row").applyInArrow(_added, "row long, sums binary")
    return {r["row"]: np.frombuffer(bytes(r["sums"])) for r in sums.collect()}


def _binned(waves: Cosines, weights: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, fold = waves(_vectors(batch)), batch.column("fold").to_numpy() % FOLDS
            raw = np.array([z[i] @ weights[f] for i, f in enumerate(fold.tolist())])
            bins = np.clip(np.round(raw * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("label")], ["bin", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1,
        sample: int = SAMPLE, features: int = FEATURES, scale: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """A model from at most `sample` labelled documents; None if there are none."""
    rows = settled(labelled(docs, labels, label, modulus, held_out, sample).mapInArrow(
        _measured, "x binary, label double, fold long"))
    moments = _summed(rows, _moments)
    if not moments:
        return None
    n, first, second = moments[0], moments[1], moments[2]
    waves = cosines(first / n, np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)), features, scale, seed)
    sums = _summed(rows, _equations(waves))
    size = features + 1
    parts = {f: np.stack([sums[f * 10_000 + i] for i in range(size)]) for f in range(FOLDS) if f * 10_000 in sums}
    whole = sum(parts.values())

    def solved(total: np.ndarray) -> np.ndarray:
        count = max(total[-1, size - 1], 1)
        return np.linalg.solve(total[:, :size] + ridge * count / features * np.eye(size), total[:, size])

    others = {f: solved(whole - part) if len(parts) > 1 else solved(whole) for f, part in parts.items()}
    bins = (rows.mapInArrow(_binned(waves, others), "bin long, label double").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect())
    knots, levels = isotonic(*(np.array([r[k] for r in bins], float) for k in ("bin", "n", "y")))
    return Model(waves, solved(whole), knots / BINS, levels)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1,
           sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    The score depends on the text alone, and a missing text is empty. Without any label to
    learn from every score is 0.5. A missing doc_id stays missing; other columns are not read.
    """
    model = fit(docs, labels, label, modulus, held_out, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = arrays.flat(batch.column("text"))
            scores = [np.full(b - a, 0.5) if model is None else
                      model.score(statistics(data[at[a]:at[b]], at[a:b + 1] - at[a])) for a, b in arrays.slices(at)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(modulus) == held_out).alias("held_out"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
