import numpy as np

from laurel.llm import outliers

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts_and_limits(odd, odd_rows, plainly):
    found = outliers.screened(odd).collect()
    assert len(found) == len(odd_rows)
    expected = sorted((str(r[0]), *plainly.text_counts(r[1])) for r in odd_rows)
    assert sorted((str(r["doc_id"]), *(r[c] for c in COUNTS)) for r in found) == expected
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_empty_table(empty):
    assert outliers.screened(empty).collect() == []


def test_only_short_texts(spark):
    df = spark.createDataFrame([(1, "x y", "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in outliers.screened(df).collect()] == [False, False]


def test_registered_query(spark, small_rows, plainly):
    from laurel.llm.queries import op7_outliers

    found = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in op7_outliers(spark, "/root/testdata/sf0.001").collect()}
    assert found == {r[0]: plainly.text_counts(r[1]) for r in small_rows}


def test_estimates_resist_a_third_of_outliers(spark):
    random = np.random.default_rng(1)
    good = random.multivariate_normal([1, 2, 3, 4], np.diag([.5, .4, .6, .3]) ** 2 + .02, 3000)
    bad = random.normal(12, 0.3, (900, 4))
    rows = [("g", *map(float, x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "g string, v0 double, v1 double, v2 double, v3 double")
    e = outliers.estimates(df, ["g"], 0.75, 3).first()
    mean = np.array([e[f"m{i}"] for i in range(4)])
    factor = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert np.abs(mean - good.mean(axis=0)).max() < 0.05
    real = np.cov(good.T) + np.diag(np.square(outliers.NARROWEST))
    ratio = (factor @ factor.T / real)[np.diag_indices(4)]
    assert ratio.min() > 0.9 and ratio.max() < outliers.consistency(0.75)  # the closest 3/4 are nearly all good rows


def test_distance_is_mahalanobis(spark):
    covariance = np.array([[2, .3, .1, 0], [.3, 1, .2, .1], [.1, .2, 3, .4], [0, .1, .4, 1.5]])
    factor = np.linalg.cholesky(covariance)
    x, m = np.array([1., -2, 3, .5]), np.array([.2, .1, -.3, 1])
    row = {**{f"v{i}": float(x[i]) for i in range(4)}, **{f"m{i}": float(m[i]) for i in range(4)},
           **{f"l{i}{j}": float(factor[i, j]) for i in range(4) for j in range(i + 1)}}
    found = spark.createDataFrame([row]).select(outliers._distance().alias("d")).first()["d"]
    assert abs(found - (x - m) @ np.linalg.inv(covariance) @ (x - m)) < 1e-9


def test_consistency_of_the_closest_three_quarters():
    assert abs(outliers.consistency(0.75) - 1.486) < 0.01
