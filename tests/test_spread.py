"""Lists of hot keys of any length: what is broadcast and what the joins return."""

import pytest
from pyspark.sql import functions as F

from laurel.functions import spread
from laurel.functions.spread import hot_keys, hottest, list_join, slice_cells, slices_by_cell, spread_join

from tests.test_plans import text


@pytest.fixture
def many(spark):
    """6,000 rows: three keys with 1,000 each, 700 others, some without a key."""
    key = F.when(F.col("id") < 3000, F.col("id") % 3).otherwise(F.col("id") % 700)
    return spark.range(6000).select(F.when(F.col("id") % 500 != 0, key).alias("k"), "id")


@pytest.fixture
def hot(many):
    return hot_keys(many.filter("k IS NOT NULL").groupBy("k").count(), ["k"], "count", 3)


@pytest.mark.parametrize("most", [1 << 14, 5, 0])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_long_lists_join_the_same_pairs(spark, many, hot, monkeypatch, most, how):
    monkeypatch.setattr(spread, "MOST_LISTED", most)
    one = spark.range(900).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))  # keys of another type
    got = spread_join(many, one, ["k"], hot, "id", how, written=True).collect()
    assert sorted(got, key=str) == sorted(many.join(one, "k", how).collect(), key=str)


def test_every_hot_key_gets_its_slices_from_the_cells(spark, hot):
    n_keys = hot.count()
    cells = slice_cells(hot, ["k"], n_keys)
    found = slices_by_cell(spark.range(100_000).withColumnRenamed("id", "k"), *cells, [F.col("k")])
    found = found.join(hot, "k", "left")
    assert found.filter(F.col("_slices") > F.col("_by_cell")).isEmpty()
    # keys that are not listed: most have one slice
    assert found.filter("_slices IS NULL AND _by_cell > 1").count() < 15_000


def test_a_long_list_is_not_broadcast(spark, many, hot, monkeypatch, tmp_path):
    """The lists, some millions of keys at 360 times sf0.1, were broadcast whole."""
    hot.write.parquet(f"{tmp_path}/hot")
    hot = spark.read.parquet(f"{tmp_path}/hot")
    assert hottest(hot) == (hot.count(), 0)
    monkeypatch.setattr(spread, "MOST_LISTED", 5)
    n_keys, power = hottest(hot)
    assert n_keys == hot.count() == 697
    assert hot.filter(spread._power() > power).count() == 3
    for how in ("left_semi", "left_anti"):
        joined = list_join(many, hot, "k", how)
        assert "Broadcast" not in text(joined)
        assert joined.count() == many.join(hot, "k", how).count()
    plan = text(spread_join(many, many.select("k"), ["k"], hot, "id", written=True))
    assert plan.count("Scan parquet") and "SortMergeJoin" in plan
