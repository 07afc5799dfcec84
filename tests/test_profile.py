from dataclasses import replace

from laurel.functions.columns import author_slots
from laurel.operators import authorship, profile, subjects

from tests.conftest import as_dict, paper, rows_of


def test_counted_publications(publications, cfg):
    pubs = publications([paper(1), paper(2, coll="PP"), paper(3, 2021), paper(4, coll="MEDL")])
    ids = lambda c: sorted(r.eid for r in authorship.counted_publications(pubs, c).collect())
    assert ids(cfg) == [1, 4]
    assert ids(replace(cfg, include_preprints=True)) == [1, 2, 4]


def test_author_slots(publications):
    pubs = publications([paper(1, authors=[None, 4, 7, "x9"]), paper(2)])
    slots = pubs.select("eid", author_slots().alias("slots"))
    rows = authorship.explode_authors(slots).collect()
    assert [(r.eid, r.auid, r.author_seq, r.n_authors) for r in rows] == [(1, 7, 3, 4)]


def test_positions_and_ranges(publications, discontinued, no_classes, cfg):
    rows = [
        paper(1, 1950, authors=[10]),               # alone, before the range
        paper(2, 2000, authors=[10, 11]),           # first
        paper(3, 2001, authors=[11, 10], srcid=5),  # last, discontinued
        paper(4, 2002, authors=[11, 10, 12]),       # middle
        paper(5, 2003, authors=[10, 12], kind="ed"),
        paper(6, 2003, authors=[10]),
        paper(7, 2005, authors=[20], refs=[1, 2, 3, 4]),
        paper(8, 2005, authors=[10], refs=[2], srcid=5, kind="ed"),
    ]
    pubs = publications(rows)
    ap, edges = rows_of(pubs, discontinued([5]), no_classes, cfg)
    m = {r.auid: r for r in profile.paper_metrics(ap, cfg).collect()}
    assert set(m) == {10}  # the others have fewer than five core papers
    a = m[10]
    assert (a.n_core, a.np, a.np_range) == (5, 7, 6)
    assert (a.ws_nc, a.ns_nc) == (5, 4)
    assert (a.ws_npc, a.ns_npc, a.ws_npc_range) == (4, 4, 3)
    assert (a.ws_nps, a.ws_npsf, a.ws_npsfl) == (3, 5, 6)
    assert (a.ws_ncs, a.ws_ncsf, a.ws_ncsfl) == (1, 3, 4)
    assert (a.np_discontinued, a.np_range_discontinued, a.ws_nc_discontinued) == (2, 2, 1)
    citing = as_dict(profile.distinct_citing(ap, edges, cfg), "auid", "ns_nc_citing",
                     "ws_nc_citing")
    assert citing[10] == (1, 2)


def test_lower_year_restricts_after_positions(author_rows, cfg):
    rows = author_rows([(9, i, c, 1) for i, c in enumerate([9, 8, 7, 6, 5])])
    run = replace(cfg, overall_min_year=2001, min_cite_year=2001)
    assert profile.paper_metrics(rows, run).count() == 0
    assert profile.paper_metrics(rows, cfg).collect()[0].ws_h == 5


def test_duplicate_author_slots_repeat_rows(publications, discontinued, no_classes, cfg):
    pubs = publications([paper(1, authors=[10, 10])])
    ap, _ = rows_of(pubs, discontinued([]), no_classes, cfg)
    assert [(r.auid, r.author_seq, r.n_authors) for r in ap.collect()] == [(10, 1, 2), (10, 2, 2)]


def classified(author_rows, spec):
    parts = None
    for start, (kind, subfield, field, count, auid) in enumerate(spec):
        rows = author_rows(
            [(auid, start * 1000 + i, 0, 1) for i in range(count)],
            is_core=kind != "ed", subfield=subfield, field=field,
        )
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def test_subject_ranking(author_rows, cfg):
    rows = classified(author_rows, [
        ("ar", "X", "F", 2, 9), ("cp", "Y", "F", 2, 9), ("re", "Z", "G", 1, 9),
        ("ed", None, "F", 1, 9), ("ar", None, None, 2, 9),
        ("ar", "X", "F", 8, 50), ("ar", "Y", "F", 2, 51), ("ar", "W", "F", 4, 51),
    ])
    counts = subjects.subject_counts(rows, cfg)
    volumes = subjects.subject_volumes(counts)
    overall = as_dict(volumes.filter("level = 'subfield'"), "subject", "n_overall")
    assert overall == {"X": 10, "Y": 4, "Z": 1, "W": 4, None: 3}
    both = {r.auid: (r.subfields, r.fields) for r in subjects.rank_subjects(counts, volumes).collect()}
    mine, fields = both[9]
    assert [(f.subject, f.n_author) for f in fields] == [("F", 5), ("G", 1), (None, 2)]
    assert [(s.rank, s.subject, s.n_author) for s in mine] == [
        (1, "Y", 2), (2, "X", 2), (3, "Z", 1), (4, None, 3),
    ]
    assert [round(s.fraction, 6) for s in mine[:3]] == [0.333333, 0.333333, 0.166667]


def test_subjects_outside_the_lower_year_are_ranked_but_not_listed(author_rows, cfg):
    old = author_rows([(9, i, 0, 1) for i in range(4)], subfield="X", field="F", year=1990)
    new = author_rows([(9, 10 + i, 0, 1) for i in range(2)], subfield="Y", field="F", year=2000)
    run = replace(cfg, overall_min_year=1996)
    counts = subjects.subject_counts(old.unionByName(new), run)
    ranked = subjects.rank_subjects(counts, subjects.subject_volumes(counts))
    assert [(s.rank, s.subject) for s in ranked.collect()[0].subfields] == [(2, "Y")]


def test_main_subjects_without_classified_paper(author_rows, cfg):
    rows = classified(author_rows, [("ar", None, None, 6, 9)])
    counts = subjects.subject_counts(rows, cfg)
    ranked = subjects.rank_subjects(counts, subjects.subject_volumes(counts))
    top = subjects.top_subjects(ranked).collect()[0]
    assert (top.subfield_1, top.subfield_1_frac, top.subfield_2, top.field_1) == (None,) * 4


def test_pairs_of_one_paper_with_many_citations_and_authors_are_sliced(spark, author_rows, cfg):
    """60 citations by 40 authors make 2,400 pairs; no slice may hold more than the limit."""
    rows = author_rows([(100 + a, 1, 60, 40) for a in range(40)] + [(100, 2, 1, 1)])
    edges = spark.createDataFrame(
        [(1000 + i, 1, i % 2) for i in range(60)] + [(1000, 2, 0)], "citing_eid long, cited_eid long, is_self int"
    )
    run = replace(cfg, hot_key_rows=300)
    got = as_dict(profile.distinct_citing(rows, edges, run), "auid", "ns_nc_citing", "ws_nc_citing")
    assert got == {100 + a: (30, 60) for a in range(40)}
    assert got == as_dict(profile.distinct_citing(rows, edges, cfg), "auid", "ns_nc_citing", "ws_nc_citing")
