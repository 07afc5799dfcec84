from pyspark.sql import functions as F

from laurel.functions import bloom


def test_all_ids_pass_and_few_others(spark):
    ids = spark.range(-30_000, 30_000, 3)
    bits = bloom.filter_bits(20_000)
    words = bloom.bloom_filter(ids, "id", bits)
    row = words.first()["words"]
    assert len(row) * len(row[0]) * 64 == bits
    asked = spark.range(-30_000, 30_000).filter(bloom.might_hold(words.scalar(), bits, F.col("id")))
    assert asked.filter("id % 3 = 0").count() == 20_000
    assert asked.filter("id % 3 != 0").count() < 0.03 * 40_000


def test_nothing_passes_an_empty_filter(spark):
    words = bloom.bloom_filter(spark.range(0), "id", bloom.LEAST_BITS)
    asked = spark.range(1000).filter(bloom.might_hold(words.scalar(), bloom.LEAST_BITS, F.col("id")))
    assert asked.count() == 0


def test_bits_are_a_power_of_two_within_bounds():
    assert bloom.filter_bits(0) == bloom.filter_bits(1) == bloom.LEAST_BITS
    assert bloom.filter_bits(1_000_000) == 1 << 23
    assert bloom.filter_bits(10**10) == bloom.MOST_BITS


def test_an_id_travels_once(spark):
    """An id sent three rows, one for each of its bits."""
    ids = spark.range(0, 40_000, 1, 4)
    bits = bloom.filter_bits(40_000)
    words = bloom.bloom_filter(ids, "id", bits)
    plan = words._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()
    assert words.count() == 1
