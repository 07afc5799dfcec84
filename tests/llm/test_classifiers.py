import zlib

import numpy as np
import pytest

from laurel.llm import quality, toxicity
from laurel.llm.toxicity import INSULT, NEGATION, OTHER, REPORTED, STRONG, TARGET, THREAT, WEAK

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(rows, labels, column, modulus, remainder):
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1
    return [(r["score"], r["predicted"], labels[r["doc_id"]][column]) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_quality_on_held_out_rows(spark, labels):
    from laurel.llm.queries import op1_quality

    rows = op1_quality(spark, SF).collect()
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    found = held(rows, labels, "quality", 3, 1)
    assert np.mean([p == y for _, p, y in found]) > 0.95


def test_toxicity_on_held_out_rows(spark, labels):
    from laurel.llm.queries import op9_toxicity

    rows = op9_toxicity(spark, SF).collect()
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    found = held(rows, labels, "toxic", 4, 2)
    assert np.mean([p == y for _, p, y in found]) > 0.9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_and_empty_tables(spark, odd, odd_rows, empty, module):
    schema = "doc_id long, quality int, toxic int, text string"
    rows = [(i, i % 2, (i + 1) % 2, "x") for i in range(1, 16)] + [(None, 1, 1, "x"), (3, None, None, "x"), (99, 1, 1, "x"), (2, 1, 1, "x")]
    labels = spark.createDataFrame(rows, schema)
    found = module.scored(odd, labels).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    same = {r["score"] for r in found if r["doc_id"] == 1}
    assert len(same) == 1
    assert module.scored(empty, labels).collect() == []
    assert len(module.scored(odd, labels.limit(0)).collect()) == len(odd_rows)


def test_isotonic_rises_and_keeps_the_mean():
    random = np.random.default_rng(2)
    x, n = np.arange(50.0), random.integers(1, 20, 50).astype(float)
    y = np.minimum(n, np.round(n * np.clip(x / 50 + random.normal(0, .2, 50), 0, 1)))
    knots, levels = quality.isotonic(x, n, y)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


def test_isotonic_rises_where_small_pools_follow_large_ones():
    _, levels = quality.isotonic(np.arange(3.0), np.array([2.0, 1000, 3]), np.array([1.0, 510, 3]))
    assert (np.diff(levels) > 0).all() and (0 < levels).all() and (levels < 1).all()


def pooled_by_search(n, y):
    """The rising step function nearest to the means: max over starts of min over ends of block means."""
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n, y)]
    def mean(a, b):
        return (sums[1][b + 1] - sums[1][a]) / (sums[0][b + 1] - sums[0][a])
    k = range(len(n))
    return [max(min(mean(a, b) for b in k if b >= i) for a in k if a <= i) for i in k]


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_against_the_min_max_formula(seed):
    random = np.random.default_rng(seed)
    n = random.integers(1, 9, 25).astype(float)
    y = random.binomial(n.astype(int), np.linspace(0.1, 0.9, 25)).astype(float)
    mean = y.sum() / n.sum()
    knots, levels = quality.isotonic(np.arange(25.0), n, y)
    expected = pooled_by_search(n + 0.5, y + 0.5 * mean)
    assert np.allclose(levels, sorted(set(np.round(expected, 12))))


def test_cosines_approximate_the_kernel():
    random = np.random.default_rng(6)
    x = random.normal(size=(20, 4))
    z = quality.cosines(np.zeros(4), np.ones(4), 20_000, 2.0, 1)(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / (2 * 2.0 ** 2))
    assert np.abs(z @ z.T - exact).max() < 0.05


@pytest.mark.parametrize("read, written", [
    ([INSULT], [INSULT]), ([TARGET, OTHER, INSULT], [OTHER, OTHER, STRONG]), ([NEGATION, OTHER, INSULT], [OTHER, OTHER, WEAK]),
    ([NEGATION, OTHER, OTHER, OTHER, INSULT], [OTHER] * 4 + [INSULT]), ([REPORTED, OTHER, INSULT], [OTHER, OTHER, WEAK]),
    ([THREAT, OTHER], [OTHER, OTHER]), ([TARGET, THREAT], [OTHER, THREAT]), ([TARGET, NEGATION, THREAT], [OTHER, OTHER, WEAK]),
])
def test_grammar(read, written):
    state, out = 0, []
    for x in read:
        state, y = toxicity.MACHINE[state][x]
        out.append(y)
    assert out == written


def test_clauses_not_words():
    lexicon = toxicity.Lexicon({"fool": 1.0}, {"grz": 0.5})

    def score(text):
        return sum(toxicity.clause_scores(text, lexicon)[0])

    assert score("you fool") > score("the fool") > score("not a fool") > 0
    assert score("you. a fool") == score("a fool") and score("grzabc") == 0.5
    assert score("he wrote fool") < score("he wrote. fool")
    assert score("") == score("kill time") == 0


def test_words_of_copies_are_no_insults(spark):
    """Twenty copies of one toxic text: only words met in several contexts count."""
    toxic = [(i, " ".join(["lorem ipsum dolor sit amet", "grumbly", "consectetur"]), 1) for i in range(20)]
    toxic += [(100 + i, f"a{i} grumbly b{i} c{i}", 1) for i in range(20)]
    clean = [(200 + i, f"d{i} e{i} f{i} the of and", 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic + clean], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic + clean], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "grumbly" in model.lexicon.words and "lorem" not in model.lexicon.words
