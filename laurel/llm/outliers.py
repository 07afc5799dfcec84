"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each text gives a vector of transformed statistics. For every (language, source) the mean
and covariance are those of the half to three quarters of its documents that lie closest
together, found as the minimum covariance determinant is: start from medians, measure all
Mahalanobis distances, estimate again from the closest, and repeat. A document is rejected
if its distance is beyond `cutoff`. Groups with few documents use the estimate over all.

Everything is DataFrame functions; a group is only ever aggregated, never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, spread_join
from laurel.llm.tables import id_of, settled

#: A group with more rows than this is dealt over several tasks.
HOT_LIMIT = 5_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("v0", "v1", "v2", "v3")
# Spread that is noise in each statistic, whatever the group: no covariance is narrower.
NARROWEST = (0.15, 0.3, 0.3, 0.16)


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the list.

    Windows are compared by 64-bit fingerprints within one text.
    """
    n = F.size(words) - 2

    def of(w: Column) -> Column:
        zipped = F.arrays_zip(F.slice(w, 1, F.size(w) - 2).alias("a"), F.slice(w, 2, F.size(w) - 2).alias("b"),
                              F.slice(w, 3, F.size(w) - 2).alias("c"))
        return bound(F.transform(zipped, lambda x: F.xxhash64(x["a"], x["b"], x["c"])), covered)

    def covered(h: Column) -> Column:
        twice = F.size(F.array_distinct(h)) < F.size(h)
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(twice, bound(ordered, places)).otherwise(F.lit(0))

    def places(s: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(other["h"] == x["h"], F.lit(False))

        again = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        three = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(three))

    return F.when(n > 0, bound(words, of)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return docs.select(
        id_of().alias("id"), F.col("doc_id"), "lang", "source",
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
             F.col("w.r").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics: word length, symbols, repeated lines, repeated words."""
    n = F.col("n_words") + 1
    return [F.log((F.col("word_chars") + 1) / n), F.log1p(50 * F.col("n_symbols") / (F.col("word_chars") + 1)),
            F.log1p(20 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and covariance of the statistics of each group, as columns m<i> and c<i><j>."""
    p = range(len(STATISTICS))
    v = [F.col(c) for c in STATISTICS]
    found = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v[i]).alias(f"m{i}") for i in p],
        *[F.covar_pop(v[i], v[j]).alias(f"c{i}{j}") for i in p for j in p if j <= i])
    return found


def _factored(found: DataFrame, factor: float) -> DataFrame:
    """The Cholesky factor of each covariance, l<i><j>; `factor` undoes the choice of the closest."""
    out = found
    for i in range(len(STATISTICS)):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}") * factor + (NARROWEST[i] ** 2 if i == j else 0.0)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.drop(*[f"c{i}{j}" for i in range(len(STATISTICS)) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance from m<i> by l<i><j>."""
    solved: list[Column] = []
    for i in range(len(STATISTICS)):
        s = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for j in range(i):
            s = s - F.col(f"l{i}{j}") * solved[j]
        solved.append(s / F.col(f"l{i}{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def consistency(share: float) -> float:
    """What the covariance of the closest `share` of four-dimensional normal vectors falls short by."""
    low, high = 0.0, 100.0
    for _ in range(80):
        q = (low + high) / 2
        low, high = (q, high) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (low, q)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def estimates(rows: DataFrame, by: list[str], share: float, steps: int) -> DataFrame:
    """Minimum-covariance-determinant means m<i> and factors l<i><j> of each group.

    Starts from medians and widths that the middle of each statistic has, then takes `steps`
    rounds of distances and estimates from the closest `share`.
    """
    p = range(len(STATISTICS))
    if "spread" not in rows.columns:
        rows = rows.withColumn("spread", F.xxhash64(*STATISTICS))
    middle = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile_approx(STATISTICS[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in p])
    zero = F.lit(0.0)
    now = middle.select(
        *by, "n", *[F.get(f"q{i}", 1).alias(f"m{i}") for i in p],
        *[(F.sqrt(F.pow((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, 2) + NARROWEST[i] ** 2) if i == j else zero)
          .alias(f"l{i}{j}") for i in p for j in range(i + 1)])
    for _ in range(steps):
        far = _with(rows, now, by).select(*by, *STATISTICS, _distance().alias("d"), "spread")
        limit = far.groupBy(*by).agg(
            F.percentile_approx("d", share, 1000).alias("limit"), F.count(F.lit(1)).alias("n"))
        near = _with(far, limit, by).filter("d <= limit")
        now = settled(_factored(_moments(near, by), consistency(share)))
    return now


def _with(rows: DataFrame, found: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Each row with what was found for its group; groups of many rows are dealt out by `spread`."""
    return spread_join(rows, found, by, hot_keys(found, by, "n", HOT_LIMIT), "spread", how)


def screened(docs: DataFrame, share: float = 0.75, steps: int = 2, cutoff: float = 23.5,
             least_rows: int = 200) -> DataFrame:
    """One row for each row of docs: doc_id, the counts of `measured`, base_failed, distance, kept.

    base_failed: under 50 words, or over half of the words in repeated three-word windows.
    Estimates come from the rows that pass. A missing text is empty; a missing lang or source
    is one of its own. Groups with fewer than `least_rows` rows are judged by the estimate
    over all rows; without any row that passes there is no distance, and rows that pass are
    kept. `cutoff` is a squared distance; 23.5 is what one in 10,000 normal vectors exceeds.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settled(measured(docs).withColumn("base_failed", base))
    names = rows.columns
    rows = rows.withColumns({
        "g0": F.coalesce(F.col("lang").cast("string"), F.lit("")), "g1": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "g2": F.lit(0), "spread": F.xxhash64("doc_id", *names), **dict(zip(STATISTICS, vector()))})
    both = F.explode(F.array(F.struct("g0", "g1", "g2"), F.struct(F.lit("").alias("g0"), F.lit("").alias("g1"), F.lit(1).alias("g2"))))
    good = rows.filter(~F.col("base_failed")).select(both.alias("g"), *STATISTICS, "spread").select("g.*", *STATISTICS, "spread")
    found = estimates(good, ["g0", "g1", "g2"], share, steps)
    own = found.filter((F.col("g2") == 0) & (F.col("n") >= int(least_rows * share)))
    whole = found.filter("g2 = 1").first()
    parts = [f"m{i}" for i in range(4)] + [f"l{i}{j}" for i in range(4) for j in range(i + 1)]
    joined = _with(rows, own.select("g0", "g1", F.col("n"), *parts), ["g0", "g1"], "left")
    if whole is not None:
        joined = joined.withColumns({c: F.coalesce(c, F.lit(whole[c])) for c in parts})
    out = joined.select(*names, _distance().alias("distance"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return out.withColumn("kept", kept).drop("lang", "source")
