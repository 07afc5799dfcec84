"""Toxicity by a weighted finite-state grammar over clauses.

Every word has a class: insult, threat, target, negation, reported speech or other. Small
sequential transducers, one for each of these, rewrite the classes of a clause; composed
they form one machine. A threat counts only with a target, a target makes an insult
stronger, a negation shortly before or a verb of saying earlier in the clause makes it
weaker. A clause scores the sum of what is left, each insult by its weight; a document is
judged by its clauses, with a logistic curve on top.

The weights, and which words insult, are learned from labels: words and word beginnings
whose odds differ between toxic and other texts. They are counted in distinct contexts, not
in documents, so that the words of a text with many copies do not pass for insults.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.learning import SAMPLE, labelled, remainder
from laurel.llm.tables import settled, text_of

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, WEAK, STRONG = range(8)

# Words the grammar knows without any label.
WORDS = {
    INSULT: "idiot idiots moron morons stupid imbecile pathetic worthless scum trash loser disgusting "
            "idiota estúpido imbécil crétin idiote stupide dummkopf trottel arschloch",
    THREAT: "kill hurt destroy stab shoot matar mataré tuer tuerai töten umbringen",
    TARGET: "you your yourself u he she they him her them tú usted eres toi vous tu es du dich dir ihr",
    NEGATION: "not never no isn't aren't nunca ne pas jamais nicht kein keine nie",
    REPORTED: "said says wrote called quoted reported dijo dit sagte schrieb",
}
TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;:\n]")
END = re.compile(r"[.!?;:\n]")
PREFIXES = (3, 4, 5, 6)
#: What a clause gets for each symbol that the machine writes, times the weight of the word.
WORTH = {INSULT: 1.0, STRONG: 1.3, WEAK: 0.3, THREAT: 1.0}
MEMO = 300_000


class Transducer:
    """Deterministic: step(state, symbol) gives the next state and what is written."""

    def __init__(self, states: int, rules: dict[tuple[int, int], tuple[int, int]], default):
        self.table = [[rules.get((s, x), default(s, x)) for x in range(8)] for s in range(states)]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""
        n = len(other.table)
        out = Transducer(0, {}, None)
        out.table = [[(a * n + other.table[b][y][0], other.table[b][y][1]) for a, y in row]
                     for row in self.table for b in range(n)]
        return out


def grammar(reach: int = 3) -> Transducer:
    """Threats need targets; negation reaches `reach` words; targets and reports reach to the clause's end."""
    threat = Transducer(2, {(0, TARGET): (1, TARGET), (0, THREAT): (0, OTHER)}, lambda s, x: (s, x))
    weaker = {(s, x): (s - 1, WEAK) for s in range(1, reach + 1) for x in (INSULT, THREAT)}
    negation = Transducer(reach + 1, weaker | {(s, NEGATION): (reach, OTHER) for s in range(reach + 1)},
                          lambda s, x: (max(0, s - 1), x))
    reported = Transducer(2, {(0, REPORTED): (1, OTHER), (1, INSULT): (1, WEAK), (1, THREAT): (1, WEAK)},
                          lambda s, x: (s, x))
    target = Transducer(2, {(0, TARGET): (1, OTHER), (1, INSULT): (1, STRONG)}, lambda s, x: (s, x))
    return threat.then(negation).then(reported).then(target)


MACHINE = grammar().table


@dataclass
class Lexicon:
    """The class and weight of each word: whole words first, then the longest known beginning."""

    words: dict[str, float]
    beginnings: dict[str, float]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self):
        self.base = {w: (k, 1.0) for k, text in WORDS.items() for w in text.split()}

    def of(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MEMO:
                self.known.clear()
            found = self.known[word] = self._of(word)
        return found

    def _of(self, word: str) -> tuple[int, float]:
        if END.match(word):
            return -1, 0.0
        weight = self.words.get(word)
        if weight is not None:
            return INSULT, weight
        if word in self.base:
            return self.base[word]
        for n in reversed(PREFIXES):
            if len(word) >= n:
                weight = self.beginnings.get(word[:n])
                if weight is not None:
                    return INSULT, weight
        return OTHER, 0.0


def clause_scores(text: str, lexicon: Lexicon) -> tuple[list[float], set[str], int]:
    """(the score of each clause that matches, its insulting words, number of words)."""
    tokens = TOKEN.findall(text.lower())
    classes = [lexicon.of(t) for t in tokens]
    scores: list[float] = []
    hits: set[str] = set()
    start = 0
    stops = [i for i, (c, _) in enumerate(classes) if c == -1]
    marked = [i for i, (c, _) in enumerate(classes) if c in (INSULT, THREAT)]
    if not marked:
        return scores, hits, len(tokens) - len(stops)
    at = 0
    for stop in [*stops, len(classes)]:
        inside = at
        while at < len(marked) and marked[at] < stop:
            at += 1
        if at > inside:
            state, total = 0, 0.0
            for i in range(start, stop):
                kind, weight = classes[i]
                state, written = MACHINE[state][kind]
                if written in WORTH:
                    total += WORTH[written] * weight
                    hits.add(tokens[i])
            if total > 0:
                scores.append(total)
        start = stop + 1
    return scores, hits, len(tokens) - len(stops)


def features(found: tuple[list[float], set[str], int]) -> list[float]:
    """What the curve sees of a document's clauses: the worst, the sum, distinct words, density."""
    scores, hits, n = found
    total = sum(scores)
    return [1.0, min(max(scores, default=0.0), 5.0), float(np.log1p(total)), min(len(hits), 10) / 10,
            float(np.log1p(1000 * total / (n + 50)))]


def _contexts(wanted: set[str] | None):
    """(feature, fingerprint of its context, toxic) of each text; `wanted` limits the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, int, bool, int]] = set()
            for raw, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold"))):
                tokens = [t for t in TOKEN.findall(raw.decode().lower()) if not END.match(t)]
                seen: set[str] = set()
                for i, t in enumerate(tokens):
                    for name in ("w:" + t, *("p:" + t[:n] for n in PREFIXES if len(t) > n)):
                        if name in seen or wanted is not None and name not in wanted:
                            continue
                        seen.add(name)
                        around = " ".join(tokens[max(0, i - 1):i + 2])
                        rows.add((name, zlib.crc32(around.encode()), label > 0, fold % 2))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64()))],
                ["name", "context", "toxic", "half"])

    return run


CONTEXTS = "name string, context long, toxic boolean, half long"


def _counted(rows: DataFrame) -> DataFrame:
    once = rows.distinct()
    return once.groupBy("name").agg(
        *[F.count(F.when(F.col("half") == h, 1)).alias(f"n{h}") for h in (0, 1)])


def _lexicon(table: list[tuple[str, int, int]], toxic: int, clean: int, least: int, margin: float, lift: float) -> Lexicon:
    words: dict[str, float] = {}
    beginnings: dict[str, float] = {}
    for name, a, b in table:
        if a < least:
            continue
        odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
        odds -= margin * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds > lift:
            (words if name[0] == "w" else beginnings)[name[2:]] = float(odds) / 4
    return Lexicon(words, beginnings)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str) -> float:
        return self.score_of(clause_scores(text, self.lexicon))

    def score_of(self, found: tuple[list[float], set[str], int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(features(found), self.weights), -30, 30))))


#: Of the features, where there is no label to learn from.
UNLEARNED = np.array([-4.0, 1.5, 1.0, 2.0, 0.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2,
        sample: int = SAMPLE, least: int = 3, margin: float = 1.64, lift: float = 1.4) -> Model:
    """A model from at most `sample` labelled documents.

    What reaches the driver is bounded by the sample: candidate words, then their counts,
    then five features for each document. The curve is fitted to features that each half
    of the sample gets from the lexicon of the other.
    """
    rows = settled(labelled(docs, labels, label, modulus, held_out, sample))
    size = {(bool(r["t"]), r["h"]): r["n"] for r in rows.groupBy((F.col("label") > 0).alias("t"), (F.col("fold") % 2).alias("h"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = [size.get((True, h), 0) for h in (0, 1)]
    clean = [size.get((False, h), 0) for h in (0, 1)]
    if not sum(toxic) or not sum(clean):
        return Model(Lexicon({}, {}), UNLEARNED)
    hits = _counted(rows.filter("label > 0").mapInArrow(_contexts(None), CONTEXTS)).filter(f"n0 + n1 >= {least}").collect()
    wanted = {r["name"] for r in hits}
    misses = {r["name"]: (r["n0"], r["n1"]) for r in
              _counted(rows.filter("label <= 0").mapInArrow(_contexts(wanted), CONTEXTS)).collect()}
    table = [(r["name"], r["n0"], r["n1"], *misses.get(r["name"], (0, 0))) for r in hits]
    whole = _lexicon([(k, a + b, c + d) for k, a, b, c, d in table], sum(toxic), sum(clean), least, margin, lift)
    halves = [_lexicon([(k, a, c) for k, a, _, c, _ in table], toxic[0], clean[0], least, margin, lift),
              _lexicon([(k, b, d) for k, _, b, _, d in table], toxic[1], clean[1], least, margin, lift)]

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(clause_scores(raw.decode(), halves[1 - fold % 2])) for raw, fold in
                     zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label")], ["x", "y"])

    found = rows.mapInArrow(apart, "x array<double>, y double").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["y"] for r in found])
    return Model(whole, logistic(x, (y > 0).astype(float)))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2,
           sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, n_clauses.

    The score depends on the text alone; a missing text is empty. Without labels of both
    kinds only the built-in words count. A missing doc_id stays missing; other columns are
    not read.
    """
    model = fit(docs, labels, label, modulus, held_out, sample)
    return apply(docs, model, modulus, held_out, threshold)


def apply(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, clauses = [], []
            for raw in batch.column("text"):
                text = raw.as_py().decode()
                found = clause_scores(text, model.lexicon)
                scores.append(model.score_of(found))
                clauses.append(len(found[0]))
            score = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32)), pa.array(clauses, pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(modulus) == held_out).alias("held_out"),
                       text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")


def kept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below `threshold`, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = [t is None or model.score(t) < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
