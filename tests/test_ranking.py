import random
from dataclasses import replace

from pyspark.sql import functions as F

from laurel.functions.ranks import value_ranks
from laurel.operators import checks, ranking, score, thresholds

from tests.conftest import as_dict

MEASURES = score.MEASURES


def profile_of(spark, rows):
    """Profile rows from (auid, value of all six measures, np_range)."""
    columns = ["auid", "np_range"] + [f"{b}_{m}" for b in ("ns", "ws") for m in MEASURES]
    data = [(a, n, *[float(v)] * 12) for a, v, n in rows]
    return spark.createDataFrame(data, ", ".join(
        f"{c} {'long' if c in ('auid', 'np_range') else 'double'}" for c in columns
    ))


def test_composite_score_bounds(spark):
    p = profile_of(spark, [(10, 50, 3), (11, 0, 3), (12, 7, 3)])
    got = as_dict(score.composite_score(p, score.log_maxima(p)), "auid", "ns_c", "ws_c")
    assert got[10] == (6.0, 6.0)
    assert got[11] == (0.0, 0.0)
    assert 0 < got[12][0] < 6


def test_unranked_author_can_set_the_scale(spark, cfg):
    p = profile_of(spark, [(10, 50, 1), (11, 20, 3)])
    scored = score.composite_score(p, score.log_maxima(p))
    assert as_dict(scored, "auid", "ws_c")[11] < 6


def test_zero_maximum_gives_no_score(spark):
    p = profile_of(spark, [(10, 0, 3)])
    assert as_dict(score.composite_score(p, score.log_maxima(p)), "auid", "ns_c") == {10: None}


def authors(spark, rows):
    """Rows (auid, subfield, ns_c, ws_c)."""
    return spark.createDataFrame(rows, "auid long, subfield_1 string, ns_c double, ws_c double")


def test_ties_share_a_rank_and_missing_scores_come_last(spark, cfg):
    frame = authors(spark, [(1, "X", 5.0, 1.0), (2, "X", 5.0, 2.0), (3, "Y", 3.0, 3.0),
                            (4, None, None, 0.0)])
    for limit in (1_000_000, 16):
        check_ranks({
            r.auid: r
            for r in ranking.score_ranks(frame, replace(cfg, hot_key_rows=limit)).collect()
        })


def check_ranks(got):
    assert [got[i].ns_rank for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert [got[i].ws_rank for i in (1, 2, 3, 4)] == [3, 2, 1, 4]
    assert [got[i].ns_subfield_rank for i in (1, 2, 3, 4)] == [1, 1, 1, None]
    assert [got[i].ws_subfield_rank for i in (1, 2, 3, 4)] == [2, 1, 1, None]
    assert [got[i].subfield_count for i in (1, 2, 3, 4)] == [2, 2, 1, None]


def test_ranks_equal_plain_windows_with_and_without_spreading(spark, cfg):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        c = rng.choice([None, 0.0, 1.5, 1.5 + 1e-12, rng.random() * 6])
        rows.append((i, rng.choice(["X", "Y", "", None]), c, rng.random() * 6))
    frame = authors(spark, rows)
    frame.createOrReplaceTempView("ranked_authors_test")
    plain = spark.sql("""
        SELECT auid, rank() OVER (ORDER BY ns_c DESC NULLS LAST) ns_rank,
               rank() OVER (ORDER BY ws_c DESC NULLS LAST) ws_rank,
               CASE WHEN subfield_1 IS NOT NULL THEN rank() OVER (
                 PARTITION BY subfield_1 ORDER BY ns_c DESC NULLS LAST) END ns_subfield_rank,
               CASE WHEN subfield_1 IS NOT NULL THEN rank() OVER (
                 PARTITION BY subfield_1 ORDER BY ws_c DESC NULLS LAST) END ws_subfield_rank,
               CASE WHEN subfield_1 IS NOT NULL THEN count(*) OVER (PARTITION BY subfield_1) END
                 subfield_count
        FROM ranked_authors_test""")
    expected = sorted(map(repr, plain.collect()))
    for limit in (1_000_000, 399, 20):  # without and with hot scores
        got = ranking.score_ranks(frame, replace(cfg, hot_key_rows=limit))
        assert sorted(map(repr, got.select(plain.columns).collect())) == expected


def test_top_list_rule(spark, cfg):
    frame = spark.createDataFrame(
        [(i, i + 500, i + 500, i, i, 100) for i in range(1, 101)]
        + [(200, 90, 700, None, None, None), (201, 700, 700, None, None, None)],
        "auid long, ns_rank long, ws_rank long, ns_subfield_rank long, ws_subfield_rank long, "
        "subfield_count long",
    )
    run = replace(cfg, rank_cutoff=100)
    chosen = frame.filter(ranking.is_top_listed(run))
    assert sorted(r.auid for r in chosen.collect()) == [1, 2, 200]
    assert frame.filter(ranking.is_top_listed(run).isNull()).count() == 0


def test_value_ranks_counts(spark):
    frame = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "v double").select(
        F.lit("g").alias("g"), F.coalesce("v", F.lit(0.0)).alias("v")
    )
    got = as_dict(value_ranks(frame, ["g"], "v"), "v", "n", "n_before", "n_group")
    assert got == {5.0: (1, 0, 4), 1.0: (3, 1, 4)}


def ranked_rows(spark, rows):
    """Rows (author_id, subfield, ws_nc, self_share, ws_ratio, ns_ratio), ranked by ws_nc."""
    frame = spark.createDataFrame(rows, (
        "author_id long, subfield_1 string, ws_nc long, self_share double, "
        "ws_cite_ratio double, ns_cite_ratio double"
    ))
    return frame.withColumns({
        "field_1": F.upper("subfield_1"),
        "ws_c": F.col("ws_nc") / 100,
        "ns_rank": F.col("author_id"),
        "ws_rank": F.col("author_id"),
        "ns_subfield_rank": F.lit(None).cast("long"),
        "ws_subfield_rank": F.lit(None).cast("long"),
        "subfield_count": F.lit(None).cast("long"),
    })


def cutoffs(df, level, subject):
    match = F.col("subject").isNull() if subject is None else F.col("subject") == subject
    return df.filter((F.col("level") == level) & match).collect()[0]


def test_cutoffs_of_one_to_hundred(spark, cfg):
    rows = [(i, "x", i, None, 1.0, 1.0) for i in range(1, 101)]
    rows += [(200 + i, None, v, None, None, None) for i, v in enumerate([1, 1, 1, 5])]
    got = thresholds.subject_thresholds(ranked_rows(spark, rows), replace(cfg, rank_cutoff=10))
    x = cutoffs(got, "subfield", "x")
    assert [x[f"cites_{p}"] for p in (25, 50, 75, 90, 95, 99)] == [25, 50, 75, 90, 95, 99]
    assert (x.n_authors, x.n_top_rank, x.n_top_list) == (100, 10, 10)
    none = cutoffs(got, "subfield", None)
    assert [none[f"cites_{p}"] for p in (25, 50, 75, 90, 95, 99)] == [1, 1, 1, 5, 5, 5]
    assert (none.self_share_95, none.cite_ratio_99, none.n_top_list) == (None, None, None)
    assert none.n_top_self_share_95 == 0
    assert cutoffs(got, "total", "TOTAL").n_authors == 104
    assert cutoffs(got, "field", "X").n_authors == 100


def test_self_share_cutoff_is_numeric_and_ns_ratio_is_ns(spark, cfg):
    rows = [(i, "x", 10, 0.5, 1.0, 2.0) for i in range(1, 19)]
    rows += [(19, "x", 10, 0.95, 3.0, 7.0), (20, "x", 10, 1.0, 4.0, 9.0)]
    got = thresholds.subject_thresholds(ranked_rows(spark, rows), replace(cfg, rank_cutoff=1000))
    x = cutoffs(got, "subfield", "x")
    assert x.self_share_95 == 0.95
    assert (x.cite_ratio_95, x.cite_ratio_ns_95) == (3.0, 7.0)
    assert (x.top_self_share_95, x.top_cite_ratio_ns_95) == (0.95, 7.0)
    assert (x.n_top_self_share_95, x.n_top_self_share_99) == (2, 1)


def test_uniqueness_and_summary(spark):
    frame = spark.createDataFrame([(1, "f"), (1, None), (2, "f")], "auid long, field_1 string")
    assert checks.repeated_keys(frame, "auid").collect()[0].n_rows == 2
    row = checks.uniqueness_check(frame, "auid").collect()[0]
    assert (row.n_rows, row.n_repeated_rows) == (3, 2)
    try:
        checks.assert_unique(frame, "auid")
        raise AssertionError("a repeated key went unnoticed")
    except ValueError:
        pass
    assert tuple(checks.run_summary(frame).collect()[0]) == (3, 2)
