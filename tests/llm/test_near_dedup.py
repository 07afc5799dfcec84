import numpy as np

from laurel.llm import near_dedup
from laurel.llm.components import components


def check(df, rows, plainly, size, **options):
    found = near_dedup.grouped(df, size=size, **options).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plainly.near_groups(rows, size), key=str)


def test_odd_rows(odd, odd_rows, plainly):
    check(odd, odd_rows, plainly, 2, hot_limit=2, block=2_000)


def test_empty_table(empty):
    assert near_dedup.grouped(empty).collect() == []


def test_registered_query(spark, small_rows, plainly):
    from laurel.llm.queries import op3_near_dedup

    found = sorted((tuple(r) for r in op3_near_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == sorted(plainly.near_groups(small_rows, 2), key=str)


def test_chains_and_hubs_with_one_hot_key(spark, plainly):
    """Copies that are near the first but not near each other, and a chain of small changes."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(40):
        w = list(base)
        w[(k * 5) % 190:(k * 5) % 190 + 9] = [f"x{k}y{j}" for j in range(9)]
        rows.append((k + 100, " ".join(w), None, None, None))
    rows.append((500, " ".join(base), None, None, None))
    w = [f"c{i}" for i in range(100)]
    for k in range(12):
        w[k * 8:k * 8 + 4] = [f"d{k}_{j}" for j in range(4)]
        rows.append((900 - k, " ".join(w), None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(df, rows, plainly, 2, hot_limit=5, block=1_500)


def test_keys_find_all_pairs_within_the_radius():
    random = np.random.default_rng(3)
    chunks = 6
    a = random.integers(0, 1 << 16, (300, chunks * near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[random.choice(len(row), 2 * chunks - 1, replace=False)] += 1
    keys = zip(near_dedup.index_keys(a, chunks), near_dedup.index_keys(b, chunks))
    assert all(set(x.tolist()) & set(y.tolist()) for x, y in keys)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (100, 150)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert {k: v for k, v in found.items() if k < 100} == {i: 0 for i in range(61)}
    assert {found[k] for k in (100, 150, 200)} == {100}


def test_shared_counts_against_sets():
    random = np.random.default_rng(8)
    base = random.integers(0, 2**62, 300).astype(np.uint64)

    def some(n):
        return [np.unique(np.concatenate([random.choice(base, random.integers(0, 200)), random.integers(0, 2**62, 9).astype(np.uint64)]))
                for _ in range(n)]

    x, y = some(20), some(15)
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
    assert near_dedup.shared_counts(x, y).tolist() == expected


def test_blocks_are_bounded_in_documents(spark):
    """Thousands of texts of two shingles in one centre: no side of a block has many more than `wide`."""
    from pyspark.sql import functions as F

    from laurel.functions.spread import hot_keys

    members = spark.range(1, 6_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("id").alias("ca"),
                                           F.lit(0).cast("long").alias("cb"), F.lit(2.0).alias("n"))
    hub = hot_keys(members.groupBy("b").agg(F.count(F.lit(1)).alias("m")), ["b"], "m", 1_000)
    dealt = near_dedup._dealt(members, hub, near_dedup.BLOCK, 500)
    sides = dealt.groupBy("i", "j", "left").count().collect()
    assert len(sides) == 2 * 12 * 12 and max(r["count"] for r in sides) < 750


def test_many_short_texts_in_narrow_blocks(spark, plainly):
    rows = [(k, " ".join(["hello", "big", "old", "world", "of", "men", "and", f"x{k % 90}", "and", f"y{k % 70}"][:10 - k % 3]), None, None, None)
            for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(df, rows, plainly, 2, hot_limit=50, wide=7)
