import datetime as dt

from laurel.functions.spread import hot_keys
from laurel.operators import institutions, names

from tests.conftest import as_dict, author, paper


def name_of(publications, cfg, rows):
    r = names.author_names(publications(rows), cfg).filter("auid = 10").collect()[0]
    return r.authfull, r.first_pub_year, r.last_pub_year


OLD = author(10, 1, given="Jane", surname="Doe", initials="J.")
NEW = author(10, 1, surname="Doe", initials="J.")


def test_given_name_beats_date(publications, cfg):
    rows = [paper(1, 2010, authors=[OLD]), paper(2, 2020, coll="PP", authors=[NEW])]
    assert name_of(publications, cfg, rows) == ("Doe, Jane", 2010, 2020)
    assert name_of(publications, cfg, rows[1:]) == ("Doe, J.", 2020, 2020)


def test_index_names_without_surname(publications, cfg):
    rows = [paper(1, authors=[author(10, 1, given="Jane", pref="P", index="I")])]
    assert name_of(publications, cfg, rows)[0] == "P"
    rows = [paper(1, authors=[author(10, 1, index="I")])]
    assert name_of(publications, cfg, rows)[0] == "I"


def test_ties_on_one_paper_take_the_last_position(publications, cfg):
    rows = [paper(1, authors=[author(10, 1, "A", "S"), author(10, 2, "B", "S")])]
    assert name_of(publications, cfg, rows)[0] == "S, B"


def spot(eid, year, month, afid, org=("Org",), seq=1):
    return paper(
        eid, year, authors=[10], date=dt.date(year, month, 1),
        links=[(1, seq)], affiliations=[(afid, None if org is None else list(org), "XX")],
    )


def chosen(spark, publications, cfg, rows, known=()):
    links = institutions.author_affiliations(publications(rows), cfg)
    ipr = spark.createDataFrame(list(known), "afid long, preferred_name string")
    return institutions.author_institution(
        institutions.dominant_affiliation(links), ipr
    ).collect()


def test_dominant_affiliation_of_the_last_year(spark, publications, cfg):
    rows = [spot(1, 2021, 1, 3, org=None), spot(2, 2021, 2, 3, org=())]
    rows += [spot(10, 2020, 1, 7), spot(11, 2020, 3, 7), spot(12, 2020, 5, 9), spot(13, 2020, 6, 9)]
    rows += [spot(20 + i, 2019, 1, 5) for i in range(9)]
    got = chosen(spark, publications, cfg, rows, [(9, "Nine")])[0]
    assert (got.affil_id, got.inst_name, got.max_datesort) == (9, "Nine", dt.date(2020, 6, 1))


def test_equal_dates_take_the_lower_id(spark, publications, cfg):
    rows = [spot(10, 2020, 1, 7), spot(11, 2020, 6, 7), spot(12, 2020, 5, 9), spot(13, 2020, 6, 9)]
    got = chosen(spark, publications, cfg, rows)[0]
    assert (got.affil_id, got.inst_name) == (7, "Org")


def test_link_past_the_list_is_dropped(spark, publications, cfg):
    assert chosen(spark, publications, cfg, [spot(1, 2020, 1, 7, seq=2)]) == []


def test_printed_name_comes_from_the_latest_record(spark, publications, cfg):
    rows = [spot(1, 2020, 2, 7, ("New", "City")), spot(2, 2020, 1, 7, ("Old",))]
    assert chosen(spark, publications, cfg, rows)[0].affil_name == "New, City"


def test_only_matching_links(spark, publications, cfg):
    rows = [paper(1, authors=[10, 11], links=[(1, 1), (2, 2), (2, 1)],
                  affiliations=[(5, ["A"], "X"), (6, ["B"], "Y")])]
    links = institutions.author_affiliations(publications(rows), cfg)
    assert sorted((r.auid, r.affil_id) for r in links.collect()) == [(10, 5), (11, 5), (11, 6)]
    assert as_dict(links, "affil_id", "affil_name")[6] == "B"


def test_spread_left_join_keeps_every_author(spark):
    chosen = spark.createDataFrame(
        [(i, 5 if i % 3 else None, "printed", "XX", None) for i in range(60)] + [(99, 6, "p", "X", None)],
        "auid long, affil_id long, affil_name string, cntry string, max_datesort date",
    )
    ipr = spark.createDataFrame([(5, "Five"), (7, "Seven")], "afid long, preferred_name string")
    sizes = chosen.groupBy("affil_id").count()
    hot = hot_keys(sizes, ["affil_id"], "count", 10)
    plain = institutions.author_institution(chosen, ipr)
    spread = institutions.author_institution(chosen, ipr, hot)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, spread.collect()))
    assert plain.count() == 61


def test_a_paper_with_thousands_of_authors_and_links(spark, publications, cfg):
    many = 5_000
    rows = [paper(1, authors=list(range(10, 10 + many)), links=[(i, i % 50 + 1) for i in range(1, many + 1)],
                  affiliations=[(a, [f"A{a}"], "X") for a in range(50)])]
    links = institutions.author_affiliations(publications(rows), cfg)
    got = {r.auid: r.affil_id for r in links.collect()}
    assert got == {9 + i: i % 50 for i in range(1, many + 1)}


def test_a_position_that_two_slots_share_belongs_to_both(spark, publications, cfg):
    people = [(str(a), 1, None, None, None, None, None) for a in (10, 11)]
    rows = [paper(1, authors=people, links=[(1, 1)], affiliations=[(5, ["A"], "X")])]
    links = institutions.author_affiliations(publications(rows), cfg)
    assert sorted((r.auid, r.affil_id) for r in links.collect()) == [(10, 5), (11, 5)]


def test_links_by_place_and_by_join_against_a_plain_search(publications, cfg):
    import random

    rng = random.Random(9)
    rows, expected = [], []
    for eid in range(1, 1501):
        n = rng.randint(0, 6)
        seqs = list(range(1, n + 1))
        if eid % 3 == 0:
            seqs = [rng.choice([None, *range(1, 8)]) for _ in seqs]
        people = [(rng.choice([None, "x", str(rng.randint(10, 40))]), q, *[None] * 5) for q in seqs]
        places = [(rng.choice([None, a]), rng.choice([None, [], [f"O{a}"]]), "X") for a in range(rng.randint(0, 4))]
        links = [(rng.choice([None, *range(-1, 8)]), rng.choice([None, *range(0, 6)])) for _ in range(rng.randint(0, 8))]
        links = [(a, 1 if b == 0 else b) for a, b in links]
        rows.append(paper(eid, authors=people, links=links, affiliations=places))
        for a, b in links:
            if a is None or b is None or b > len(places) or not places[b - 1][1]:
                continue
            expected += [(eid, int(p[0]), places[b - 1][0], places[b - 1][1][0])
                         for p in people if p[1] == a and p[0] not in (None, "x")]
    links = institutions.author_affiliations(publications(rows), cfg)
    got = [tuple(r) for r in links.select("eid", "auid", "affil_id", "affil_name").collect()]
    assert len(expected) > 50 and sorted(got, key=repr) == sorted(expected, key=repr)


def test_repeated_records_take_the_greatest_name_once(publications, cfg):
    rows = [paper(1, authors=[author(10, 1, "A", "S")]), paper(1, authors=[author(10, 1, "B", "S")])]
    rows += [paper(2, 1990, authors=[author(11, None)])]
    got = {r.auid: tuple(r)[1:] for r in names.author_names(publications(rows), cfg).collect()}
    assert got == {10: (1, "S, B", 2000, 2000), 11: (2, None, 1990, 1990)}
    assert names.author_names(publications([]), cfg).collect() == []


def test_names_against_a_plain_search(publications, cfg):
    import random

    rng = random.Random(5)
    people = lambda: [
        author(rng.randint(1, 40), rng.choice([None, 1, 2, 3]), rng.choice([None, "G"]), f"S{rng.randint(0, 99)}", "I.")
        for _ in range(rng.randint(0, 6))
    ]
    rows = [paper(rng.randint(-50, 50), rng.randint(1950, 2020), authors=people()) for _ in range(300)]
    best = {}
    for r in rows:
        for a in r[7] or []:
            seq = -1 if a[1] is None else a[1]
            record = (a[2] is not None, r[2], r[0], seq, f"{a[3]}, {a[2] or a[4]}")
            best[int(a[0])] = max(best.get(int(a[0]), record), record)
    got = {r.auid: (r.name_eid, r.authfull) for r in names.author_names(publications(rows), cfg).collect()}
    assert got == {k: (v[2], v[4]) for k, v in best.items()}
