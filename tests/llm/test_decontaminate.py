import numpy as np

from laurel.llm import decontaminate

ITEMS = "item_id long, text string, id string"


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], ITEMS)


def test_planted_passages(spark, odd, odd_rows, plainly):
    from tests.llm.conftest import words

    base = words(2, 120).split()
    wanted = [(1, " ".join(base[20:60])), (2, " ".join(base[3:14])), (3, " ".join(base[30:36])), (4, words(77, 40)), (5, " ".join(base[90:120])),
              (6, " ".join(base[20:60])), (7, "two words"), (8, None), (9, "")]
    found = decontaminate.matches(odd, items(spark, wanted)).collect()
    texts = [r for r in odd_rows if r[0] is not None]
    expected = plainly.leaks(texts, [w for w in wanted if w[1] and len(w[1].split()) > 4])
    assert {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] is not None} == expected
    assert any(r["doc_id"] is None for r in found)


def test_several_passes_give_the_same(spark, odd):
    from tests.llm.conftest import words

    rows = items(spark, [(i, " ".join(words(2, 120).split()[i * 5:i * 5 + 30])) for i in range(10)])
    one, more = (sorted(map(tuple, decontaminate.matches(odd, rows, items=k).collect()), key=str) for k in (100, 3))
    assert one == more and one


def test_empty_tables(spark, odd, empty):
    assert decontaminate.matches(odd, items(spark, [(1, "x")]).limit(0)).collect() == []
    assert decontaminate.matches(empty, items(spark, [(1, "x y z a b c d")])).collect() == []


def test_registered_query(spark, small_rows, plainly):
    from laurel.llm.queries import op8_decontaminate

    sf = "/root/testdata/sf0.001"
    found = {(r["doc_id"], r["item_id"]) for r in op8_decontaminate(spark, sf).collect()}
    wanted = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found == plainly.leaks(small_rows, wanted)


def test_blocks_find_all_fingerprints_within_the_radius():
    random = np.random.default_rng(4)
    prints = random.integers(0, 2**63, 30).astype(np.uint64)
    index = decontaminate.indexed(8, [(i, 0, int(p)) for i, p in enumerate(prints)], 4, 11)
    windows = prints[np.arange(600) % 30].copy()
    for i in range(600):
        for bit in random.choice(64, 1 + i % 14, replace=False):
            windows[i] ^= np.uint64(1 << int(bit))
    far = np.bitwise_count(windows[:, None] ^ prints)
    assert set(zip(*(x.tolist() for x in index.near(windows, 11)))) == set(zip(*(x.tolist() for x in np.nonzero(far <= 11))))


def test_shifted_and_changed_passages(spark):
    from tests.llm.conftest import words

    item = words(50, 57).split()
    rows = []
    for k in range(40):
        w = list(item)
        w[k] = "other"
        rows.append((k, words(k, 20 + k) + " " + " ".join(w) + " " + words(k + 100, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in decontaminate.matches(df, items(spark, [(1, " ".join(item))])).collect()}
    assert found == set(range(40))


def test_passages_cut_off_by_the_end_of_the_document(spark, plainly):
    """Items cut at the start or the end, alone or at the end of a text, against all windows of a plain version."""
    from tests.llm.conftest import words

    wanted = [(n, words(n, n)) for n in (9, 10, 11, 14, 20, 33, 57, 90)]
    rows, k = [], 0
    for n, text in wanted:
        w = text.split()
        for cut in range(1, n // 4 + 2):
            for part in (w[:-cut], w[cut:], words(1_000 + k, 30).split() + w[:-cut], words(1_000 + k, 3).split() + w[cut:]):
                rows.append((k, " ".join(part)))
                k += 1
        w[n // 2] = "other"
        rows += [(k, " ".join(w[:-1])), (k + 1, " ".join(w[:-2]) + "\n")]
        k += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, items(spark, wanted)).collect()}
    expected = plainly.leaks(rows, wanted)
    assert found == expected and len(found) > 80


def test_items_without_an_id_are_found_too(spark):
    from tests.llm.conftest import words

    docs = spark.createDataFrame([(1, words(5, 20) + " " + words(6, 30) + " x"), (2, words(7, 60))], "doc_id long, text string")
    wanted = items(spark, [(None, words(6, 30)), (None, words(8, 30)), (3, words(9, 30))])
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, wanted).collect()] == [(1, None)]
    assert [r["doc_id"] for r in decontaminate.kept(docs, wanted).collect()] == [2]
