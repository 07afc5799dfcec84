import numpy as np
import pytest

from laurel.llm import substring_dedup, suffix_dedup


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("length, hot", [(100, 5_000), (40, 1), (7, 3)])
def test_bytes_that_start_earlier_go(odd, odd_rows, plainly, length, hot):
    rows = [r for r in odd_rows if length > 10 or r[0] not in (9, 10, 11, 12)]
    df = odd if length > 10 else odd.filter("coalesce(doc_id, 0) not in (9, 10, 11, 12)")
    found = suffix_dedup.remove_repeats(df, length, hot_limit=hot, chunk_bytes=20_000)
    assert rows_of(found, *BYTES) == sorted(plainly.byte_repeats(rows, length), key=str)


@pytest.mark.parametrize("size, hot", [(13, 5_000), (13, 1), (3, 2)])
def test_words_of_windows_of_earlier_documents_go(odd, odd_rows, plainly, size, hot):
    found = substring_dedup.remove_windows(odd, size, hot_limit=hot, chunk_bytes=20_000)
    assert rows_of(found, *WORDS) == sorted(plainly.window_repeats(odd_rows, size), key=str)


def test_registered_queries_on_the_test_tables(spark, small_rows, plainly):
    from laurel.llm.queries import op2_suffix_dedup, op6_substring_dedup

    sf = "/root/testdata/sf0.001"
    assert rows_of(op2_suffix_dedup(spark, sf), *BYTES) == sorted(plainly.byte_repeats(small_rows, 100), key=str)
    assert rows_of(op6_substring_dedup(spark, sf), *WORDS) == sorted(plainly.window_repeats(small_rows, 13), key=str)


def test_kept_text_comes_along(odd):
    found = substring_dedup.remove_windows(odd).filter("doc_id = 8").first()
    assert found["kept"] == b"ONE"


def test_empty_tables(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert substring_dedup.remove_windows(empty).collect() == []


def factors_by_hand(data, at, place, length):
    def shared(a, b):
        return next((k for k in range(length) if data[a + k] != data[b + k]), length)

    return [max([shared(a, b) for b, q in zip(at, place) if q < p], default=0) for a, p in zip(at, place)]


@pytest.mark.parametrize("length", [1, 5, 7, 8, 9, 20, 100])
@pytest.mark.parametrize("collide", [False, True])
def test_longest_previous_factors_against_all_pairs(monkeypatch, length, collide):
    if collide:  # every fingerprint the same: the sort alone must tell the strings apart
        monkeypatch.setattr(suffix_dedup.arrays, "rolling", lambda h, width: np.zeros(len(h) - width + 1, np.uint64))
    for seed in range(4):
        random = np.random.default_rng(seed)
        data = random.integers(0, 2 + seed, 200 + length + 8).astype(np.uint8)
        if seed % 2:
            data[60:190] = data[:130]
        at = random.permutation(200)[:150]
        place = suffix_dedup.ranks(random.integers(0, 20, 150), random.integers(0, 9, 150))
        got = suffix_dedup.longest_previous_factor(data, at, place, length)
        assert got.tolist() == factors_by_hand(data.tolist(), at.tolist(), place.tolist(), length)


def test_rising_places_before_a_small_one_take_few_steps():
    n = 200_000
    place = np.append(np.arange(1, n), 0)
    assert suffix_dedup.shared_with_smaller(place, np.append(0, np.full(n - 1, 7)))[[0, 1, n - 2, n - 1]].tolist() == [0, 7, 7, 0]


def test_the_texts_are_shuffled_once(small):
    found = suffix_dedup.remove_repeats(small)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")]
    assert final.count("ReusedExchange") == 2
