import math
import random
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, running_totals
from laurel.operators import authorship, indices, profile

from tests.conftest import as_dict


def brute(rows, lower=None):
    """h and hm of one author with exact fractions; rows: (eid, cites, n, year)."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    h, hm = 0, Fraction(0)
    for eid, cites, _, year in ordered:
        before = [r for r in ordered if (-r[1], r[0]) < (-cites, eid)]
        upto = [r for r in ordered if (-r[1], r[0]) <= (-cites, eid)]
        if lower is not None and year < lower:
            continue
        if len(before) + 1 <= cites:
            h = max(h, len(before) + 1)
        share = sum(Fraction(1, r[2]) for r in upto)
        if share <= cites:
            hm = max(hm, share)
    return h, float(hm)


def test_worked_example(author_rows, cfg):
    rows = author_rows([(9, i, c, n) for i, (c, n) in enumerate(
        [(10, 1), (5, 2), (3, 1), (1, 4), (0, 1)]
    )])
    for compute in (indices.author_indices, indices.author_indices_spread):
        got = compute(rows, cfg).collect()[0]
        assert (got.ns_h, got.ns_hm, got.ws_h, got.ws_hm) == (3, 2.5, 3, 2.5)


def test_exact_tie_of_fraction_sums(author_rows, cfg):
    # ten tenths and one citation each: the running sum reaches exactly 1
    rows = author_rows([(9, i, 1, 10) for i in range(10)])
    assert indices.author_indices(rows, cfg).collect()[0].ws_hm == 1.0
    assert indices.author_indices_spread(rows, cfg).collect()[0].ws_hm == 1.0


@pytest.mark.parametrize("lower", [None, 2000])
def test_both_paths_match_brute_force(author_rows, spark, cfg, lower):
    rng = random.Random(7)
    data, expected = [], {}
    for auid in range(10, 40):
        rows = []
        for _ in range(rng.randint(1, 40)):
            eid = rng.randint(1, 1_000_000)
            row = (eid, rng.choice([0, 1, 1, 2, 3, 5, 8, 40]), rng.randint(1, 7),
                   rng.choice([1995, 2001]))
            rows.append(row)
            if rng.random() < 0.1:
                rows.append(row)  # the same author twice on one paper
        expected[auid] = brute(rows, lower)
        data += [(auid, *r) for r in rows]
    frame = author_rows([(a, e, c, n) for a, e, c, n, _ in data])
    years = spark.createDataFrame(
        sorted({(e, y) for _, e, _, _, y in data}), "eid long, y int"
    )
    frame = frame.join(years, "eid").withColumn("year", F.col("y")).drop("y")
    run = cfg if lower is None else replace(
        cfg, overall_min_year=lower, min_cite_year=2000
    )
    for compute in (indices.author_indices, indices.author_indices_spread):
        got = as_dict(compute(frame, run), "auid", "ws_h", "ws_hm")
        assert got.keys() == expected.keys()
        for auid, (h, hm) in expected.items():
            assert got[auid][0] == h
            assert math.isclose(got[auid][1], hm, abs_tol=1e-8)


def test_hot_authors_get_the_same_profile(author_rows, cfg):
    rng = random.Random(3)
    rows = author_rows(
        [(10, i, rng.randint(0, 6), rng.randint(1, 4)) for i in range(300)]
        + [(11, i, rng.randint(0, 6), rng.randint(1, 4)) for i in range(30)]
    )
    hot = hot_keys(authorship.author_sizes(rows), ["auid"], "n_rows", 100)
    assert [r.auid for r in hot.collect()] == [10]
    plain = profile.paper_metrics(rows, cfg)
    spread = profile.paper_metrics(rows, cfg, hot)
    assert plain.columns == spread.columns
    assert sorted(plain.collect()) == sorted(spread.collect())


def test_running_totals_against_brute_force(spark):
    rng = random.Random(11)
    cells = sorted({
        (rng.choice("ab"), rng.randint(0, 3), rng.randint(0, 50)) for _ in range(120)
    })
    data = [(g, x, y, rng.randint(1, 9)) for g, x, y in cells]
    frame = spark.createDataFrame(data, "g string, x int, y int, n long")
    got = running_totals(frame, ["g"], [("x", "desc"), ("y", "asc")], ["n"]).collect()
    assert len(got) == len(data)
    for row in got:
        before = sum(n for g, x, y, n in data if g == row.g and (-x, y) < (-row.x, row.y))
        assert row.n_before == before
        assert row.n_group == sum(n for g, _, _, n in data if g == row.g)


def test_cells_that_are_not_kept_are_ordered_no_further(spark):
    frame = spark.createDataFrame(
        [("a", x, y, 1) for x in range(4) for y in range(5)], "g string, x int, y int, n long"
    )
    levels = [("x", "desc"), ("y", "asc")]
    every = running_totals(frame, ["g"], levels, ["n"])
    got = running_totals(frame, ["g"], levels, ["n"], F.col("n_before") < 10)
    assert sorted(got.collect()) == sorted(every.filter("x >= 2").collect())


@pytest.mark.parametrize("lower", [None, 2001])
def test_papers_past_the_index_decide_nothing(spark, author_rows, cfg, lower):
    """all papers of hot authors were ordered through five levels."""
    rng = random.Random(29)
    rows = author_rows(
        [(a, rng.randint(0, 60), min(rng.randint(0, 9), rng.randint(0, 9)), rng.randint(1, 5))
         for a in range(10, 40) for _ in range(rng.randint(1, 40))]
        + [(50, i, 0, 3) for i in range(30)]
    ).dropDuplicates(["auid", "eid"])
    rows = rows.unionAll(rows.filter("eid % 7 = 0"))  # some twice
    rows = rows.withColumn("year", (F.lit(2000) + F.col("eid") % 3).cast("int"))
    run = replace(cfg, overall_min_year=lower, min_cite_year=2001)
    columns = ["auid", "ns_h", "ns_hm", "ws_h", "ws_hm"]
    expected = sorted(indices.author_indices(rows, run).select(columns).collect())
    for levels in (indices.ID_LEVELS, ()):
        assert sorted(indices.author_indices_spread(rows, run, levels).select(columns).collect()) == expected


def test_levels_of_the_id_only_for_authors_that_need_them(author_rows, cfg):
    rows = author_rows([(10, i, i % 4, 1) for i in range(80)])
    for limit, levels in ((25, False), (1_000_000, True)):
        run = replace(cfg, hot_key_rows=limit)
        hot = hot_keys(authorship.author_sizes(rows), ["auid"], "n_rows", 25)
        found = profile.paper_metrics(rows, run, hot)
        assert ("_id_48" in found._jdf.queryExecution().toString()) == levels
        assert [(r.ws_h, r.ws_hm) for r in found.select("ws_h", "ws_hm").collect()] == [(3, 3.0)]
