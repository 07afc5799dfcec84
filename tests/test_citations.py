import random
from dataclasses import replace

import pytest

from laurel.functions.spread import hot_keys
from laurel.operators import citations

from tests.conftest import paper

PAPERS = [
    paper(1, 1990, authors=[10, 11]),
    paper(2, 2000, authors=[11], refs=[1]),
    paper(3, 2001, coll="MEDL", authors=[12], refs=[1, 1]),
    paper(4, 1999, authors=[None]),
    paper(5, 2002, authors=[None, 13], refs=[4]),
    paper(6, 2003, coll="PP", authors=[14], refs=[1]),
    paper(7, 1995, authors=[15], refs=[1]),
    paper(8, 2004, authors=[16], refs=[999, None]),
    paper(9, 2021, authors=[17], refs=[1], srcid=7),
]


def counts(publications, discontinued, cfg, listed=()):
    edges = citations.citation_edges(publications(PAPERS), discontinued(listed), cfg)
    rows = citations.citation_counts(edges).collect()
    return {
        r.eid: (r.ws_cites, r.self_cites, r.ns_cites, r.discontinued_cites) for r in rows
    }


def test_edges_and_self_citations(publications, discontinued, cfg):
    assert counts(publications, discontinued, cfg) == {1: (3, 1, 2, 0), 4: (1, 0, 1, 0)}


def test_unknown_authors_match_only_in_strict_mode(publications, discontinued, cfg):
    strict = replace(cfg, strict_reference=True)
    assert counts(publications, discontinued, strict) == {1: (3, 1, 2, 0), 4: (1, 1, 0, 0)}


def test_placeholder_authors_do_not_match(publications, discontinued, cfg):
    rows = [paper(1, authors=[3]), paper(2, authors=[3, 50], refs=[1])]
    edges = citations.citation_edges(publications(rows), discontinued([]), cfg)
    assert [r.is_self for r in edges.collect()] == [0]
    strict = replace(cfg, strict_reference=True)
    edges = citations.citation_edges(publications(rows), discontinued([]), strict)
    assert [r.is_self for r in edges.collect()] == [1]


def test_upper_bound_on_citing_years_is_optional(publications, discontinued, cfg):
    assert counts(publications, discontinued, replace(cfg, max_cite_year=2020))[1][0] == 2


def test_discontinued_citing_sources(publications, discontinued, cfg):
    assert counts(publications, discontinued, cfg, [7, 7, 8])[1] == (3, 1, 2, 1)


def test_missing_source_id_counts_as_continued(publications, discontinued, cfg):
    rows = [paper(1), paper(2, authors=[9], refs=[1], srcid=None)]
    edges = citations.citation_edges(publications(rows), discontinued([5]), cfg)
    assert [r.is_discontinued for r in edges.collect()] == [0]


def test_spread_edges_equal_plain_edges(publications, discontinued, cfg):
    rows = [paper(1, authors=[10]), paper(2, authors=[11])]
    rows += [paper(i, authors=[i % 13 + 8], refs=[1, 2 if i % 3 else 1]) for i in range(100, 180)]
    pubs = publications(rows)
    hot = hot_keys(citations.reference_counts(pubs, cfg), ["cited_eid"], "n_references", 10)
    assert {r.cited_eid: r._slices for r in hot.collect()} == {1: 8, 2: 6}
    plain = citations.citation_edges(pubs, discontinued([]), cfg)
    spread = citations.citation_edges(pubs, discontinued([]), cfg, hot)
    assert sorted(plain.collect()) == sorted(spread.collect())
    assert plain.count() == 80 + 54  # all cite paper 1, ids not divisible by 3 also paper 2


def test_heavy_references_are_all_papers_beyond_the_limit(publications, cfg):
    rows = [paper(1)] + [paper(i, refs=[1, -3] + [i % 7] * (i % 3 > 0)) for i in range(100, 150)]
    pubs = publications(rows)
    counted = citations.reference_counts(pubs, cfg)
    for limit, cells in ((4, 1), (4, 8), (10, 1 << 20), (49, 2), (50, 2)):
        found = citations.heavy_references(pubs, cfg, limit, cells)
        assert sorted(found.collect()) == sorted(counted.filter(f"n_references > {limit}").collect())


def people(seed):
    """Papers with long, short, empty and missing author lists, many of them shared."""
    r = random.Random(seed)
    rows = []
    for i in range(60):
        n = r.choice([0, 1, 2, 5, 120])
        authors = [r.choice([None, 2, *range(5, 400)]) for _ in range(n)]
        rows.append(paper(i, authors=authors, refs=[r.randrange(90) for _ in range(6)]))
    return rows


@pytest.mark.parametrize("strict", [False, True])
def test_signatures_lose_no_self_citation(publications, discontinued, cfg, strict):
    rows = people(3)
    lists = {
        r[0]: {None if a[0] is None else int(a[0]) for a in r[7] or ()} for r in rows
    }
    if not strict:
        lists = {i: {a for a in found if a is not None and a > 4} for i, found in lists.items()}
    expected = {
        (r[0], c): int(bool(lists[r[0]] & lists[c])) for r in rows for c in set(r[5]) if c in lists
    }
    pubs = publications(rows)
    edges = citations.citation_edges(
        pubs, discontinued([]), replace(cfg, strict_reference=strict),
        known=citations.known_papers(pubs),
    )
    found = edges.collect()
    assert len(found) == len(expected)
    assert {(r.citing_eid, r.cited_eid): r.is_self for r in found} == expected
    assert 0 < sum(expected.values()) < len(expected)


def test_few_pairs_fetch_their_lists(publications, discontinued, cfg):
    rows = [paper(i, authors=[3 * i + 5, 3 * i + 6], refs=[i - 1, i - 2]) for i in range(200)]
    pairs = citations.edge_candidates(publications(rows), discontinued([]), cfg)
    assert pairs.filter("maybe_self = 1").count() <= 0.05 * pairs.count()
