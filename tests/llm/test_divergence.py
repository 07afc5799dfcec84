import os
import random

import duckdb
import pytest

from laurel.llm import divergence

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed):
    r = random.Random(seed)
    rows = []
    for i in range(200):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "b", "c", "é", None])
        words = [r.choice("abcdefghij") * r.choice([1, 1, 2]) + r.choice(["", "É", "Z", "_x"]) for _ in range(r.randint(0, 30))]
        rows.append((i % 150, " ".join(words) if r.random() < 0.9 else r.choice([None, ""]), lang, source, 0))
    return rows + [(900, "1 2 3", "xx", "only", 0), (901, None, "xx", "other", 0), (902, None, "yy", None, 0)]


@pytest.mark.parametrize("seed, top", [(1, 10), (2, 3), (3, 1)])
def test_against_the_definition(spark, plainly, seed, top):
    rows = made(seed)
    found = divergence.audit(spark.createDataFrame(rows, SCHEMA), top=top, part_terms=4)
    assert sorted(map(tuple, found.collect())) == sorted(plainly.divergence(rows, top=top))


def test_odd_rows(odd, odd_rows, plainly):
    found = divergence.audit(odd, least_docs=2)
    assert sorted(map(tuple, found.collect())) == sorted(plainly.divergence(odd_rows, least=2))


def test_sql_agrees(spark):
    from laurel.llm.queries import op12_divergence

    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = op12_divergence(spark, SF)
    expected = con.execute(f"SELECT {', '.join(found.columns)} FROM ({divergence.oracle()})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_empty_table(empty):
    assert divergence.audit(empty).collect() == []


def dominates(a, b):
    return a != b and a[0] >= b[0] and a[1] <= b[1] and a[2].encode() <= b[2].encode()


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_against_all_pairs_and_merged(k):
    r = random.Random(k)
    names = [chr(r.choice([97, 233, 8364, 0x1F600]) + i % 7) + str(i) for i in range(150)]
    rows = [(r.randint(1, 6), r.randint(1, 9), t) for t in names]
    expected = {x for x in rows if sum(dominates(y, x) for y in rows) < k}

    def band(part):
        return [part[i] for i in divergence.skyband(*map(list, zip(*part)), k)]

    assert set(band(rows)) == expected
    assert set(band(sum([band(rows[i::4]) for i in range(4)], []))) == expected


def test_counts_beyond_64_bits(spark):
    import numpy as np

    n = np.array([[10**12, 0, 9_300_000_000]])
    total = n.sum(axis=0) * 3
    assert divergence._shares(n, total, 5).tolist() == [[1 + 10**9 * (a + 2) // (b + 10) for a, b in zip(n[0].tolist(), total.tolist())]]
    row = spark.createDataFrame([(10**13, 3 * 10**13, 5)], "n long, total long, terms long").select(divergence.share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 10)
