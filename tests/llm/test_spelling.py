import itertools
import random

import pytest

from laurel.llm import spelling

NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def corrupted(seed):
    """Words over few letters, so that bigrams repeat inside words and many words are near."""
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(40)]
    texts = []
    for i in range(60):
        found = []
        for w in r.choices(base, k=60):
            at, c = r.randrange(len(w)), r.choice("abéÀ")
            found.append(r.choice([w, w.upper(), w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]]))
        texts.append((i, r.choice([" ", ", ", "1", "…"]).join(found), "en", "s", 0))
    return texts


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"times": 2, "one_in": 3}), (3, {"least_count": 1, "one_in": 7})])
def test_against_all_pairs(spark, plainly, seed, options):
    rows = corrupted(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = plainly.spelling(rows, often=options.get("least_count", 5), times=options.get("times", 5), one_in=options.get("one_in", 199))
    assert len(expected) > 100 and rows_of(spelling.variants(df, **options)) == sorted(expected, key=str)


def test_odd_rows(odd, odd_rows, plainly):
    found = spelling.variants(odd, least_count=1)
    assert rows_of(found) == sorted(plainly.spelling(odd_rows, often=1), key=str)


def test_registered_query_on_the_test_tables(spark, small_rows, plainly):
    from laurel.llm.queries import op11_spelling

    assert rows_of(op11_spelling(spark, "/root/testdata/sf0.001")) == sorted(plainly.spelling(small_rows), key=str)


def test_empty_table(empty):
    assert spelling.variants(empty).collect() == []


def test_chains_of_forms_lead_to_one_root(spark):
    words = ["aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = spark.createDataFrame([(w, f, 1, 0, None) for w, f in itertools.zip_longest(words, words[1:])],
                                 "word string, form string, n long, n_near long, form_n long")
    assert {r["root"] for r in spelling.rooted(rows).collect()} == {words[-1]}


def test_pivots_are_the_cheapest_disjoint_ones():
    r = random.Random(4)
    for _ in range(300):
        word = "".join(r.choice("abcd") for _ in range(r.randint(6, 10)))
        cost = {g: r.randint(1, 9) for g in {word[i:i + 2] for i in range(len(word) - 1)}}
        grams = [((cost[word[i:i + 2]], word[i:i + 2]), i) for i in range(len(word) - 1)]
        prefix, chosen = spelling.pivots(grams)
        rank = sorted(g for g, _ in grams)[2]
        assert prefix == [i for g, i in grams if g <= rank]
        totals = [cost[word[a:a + 2]] + cost[word[b:b + 2]] for a in prefix for b in prefix if b >= a + 2]
        assert len(chosen) == 2 and chosen[1] >= chosen[0] + 2
        assert sum(cost[word[i:i + 2]] for i in chosen) == min(totals)


def test_shares_of_whole_texts_make_the_keys(spark):
    """Candidates share the text up to the pivot or from it on, not only the bigram."""
    words = spark.createDataFrame([("abcdef", 5), ("abcdxf", 5), ("zzcdef", 5)], "word string, n long")
    assert {tuple(r) for r in spelling.links(words).collect()} == {("abcdef", "abcdxf"), ("abcdxf", "abcdef")}


def test_keys_travel_as_hashes_and_pairs_once(spark, monkeypatch):
    """F-op11: sorting texts as keys and sending a pair both ways round took the time."""
    kept = []
    whole = spelling.settled
    monkeypatch.setattr(spelling, "settled", lambda df: kept.append(df) or whole(df))
    found = spelling.links(spark.createDataFrame([("abcdef", 5), ("abcdxf", 5), ("abcdyf", 5)], "word string, n long"))
    assert dict(kept[0].dtypes)["key"] == "bigint"
    assert "least(" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == found.distinct().count() == 6
