"""The registered queries again, as SQL over the driver's tables.

Written from the definitions alone: whole-group windows and row-level joins, none
of the pre-aggregation, bucketing or staging of the Spark side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from laurel_registry.queries import HOT
from laurel_registry.tables import SPLIT


@dataclass(frozen=True)
class Run:
    min_year: int = 1995
    min_cite_year: int = 1997
    max_year: int = 2000
    lower: int | None = None
    preprints: bool = False
    cutoff: int = 100
    fraction: float = 0.05
    max_cite: int | None = None
    strict: bool = False

    @property
    def years(self) -> tuple[str, str, str]:
        return tuple(f"{y % 100:02d}" for y in (self.min_year, self.min_cite_year, self.max_year))


_RUN = Run()
_LOWER = Run(lower=1996, preprints=True)
_SINGLE = Run(min_cite_year=2000)

COUNTED = "('CORE', 'MEDL')"
MEASURES = ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")


def _ctes(run: Run) -> dict[str, str]:
    kept = "TRUE" if run.lower is None else f"yr >= {run.lower}"
    in_range = f"yr BETWEEN {run.min_year} AND {run.max_year}"
    scope = "" if run.preprints else f"AND p.coll IN {COUNTED}"
    c: dict[str, str] = {}
    c["paper"] = """
        SELECT o_orderkey eid, CAST(year(o_orderdate) AS INTEGER) yr,
               CAST(o_orderdate AS DATE) ds,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'ar' WHEN '2-HIGH' THEN 'cp'
                    WHEN '3-MEDIUM' THEN 're' ELSE 'ed' END pt,
               o_orderkey % 97 srcid,
               CASE WHEN o_orderkey % 10 = 0 THEN 'PP'
                    WHEN o_orderkey % 3 = 0 THEN 'MEDL' ELSE 'CORE' END coll,
               o_custkey custkey
        FROM orders"""
    author = f"CASE WHEN l_partkey % 5 < 2 THEN (l_partkey + 1) * {SPLIT} + l_orderkey % 40 ELSE l_partkey END"
    c["au"] = f"""
        SELECT eid, auid, CAST(row_number() OVER (PARTITION BY eid ORDER BY ln, auid) AS INTEGER) seq,
               CAST(count(*) OVER (PARTITION BY eid) AS INTEGER) n
        FROM (SELECT l_orderkey eid, {author} auid, min(l_linenumber) ln
              FROM lineitem GROUP BY l_orderkey, l_partkey) slots
        WHERE eid IN (SELECT o_orderkey FROM orders)"""
    c["refs"] = """
        SELECT DISTINCT eid citing, nullif(r, eid) cited FROM (
          SELECT eid, unnest([eid // 10, eid // 100, eid // 1000, eid % 50, eid - 7,
                 CASE WHEN eid % 6 >= 2 THEN eid - 14 END,
                 CASE WHEN eid % 6 >= 3 THEN eid - 21 END,
                 CASE WHEN eid % 6 >= 4 THEN eid - 35 END]) r
          FROM paper) listed"""
    c["edge"] = f"""
        SELECT r.citing, r.cited, CASE WHEN a.srcid < 7 THEN 1 ELSE 0 END disc
        FROM refs r JOIN paper a ON a.eid = r.citing JOIN paper b ON b.eid = r.cited
        WHERE a.yr >= {run.min_cite_year} AND a.coll IN {COUNTED}
          AND a.yr <= {9999 if run.max_cite is None else run.max_cite}"""
    c["selfs"] = f"""
        SELECT DISTINCT e.citing, e.cited
        FROM edge e JOIN au x ON x.eid = e.citing JOIN au y ON y.eid = e.cited AND y.auid = x.auid
        WHERE x.auid > {0 if run.strict else 4}"""
    c["edges"] = """
        SELECT e.citing, e.cited, e.disc, CASE WHEN s.citing IS NULL THEN 0 ELSE 1 END self
        FROM edge e LEFT JOIN selfs s ON s.citing = e.citing AND s.cited = e.cited"""
    c["cnt"] = """
        SELECT cited eid, count(*) ws, CAST(sum(self) AS BIGINT) selfs,
               CAST(count(*) - sum(self) AS BIGINT) ns, CAST(sum(disc) AS BIGINT) dc
        FROM edges GROUP BY cited"""
    c["cls"] = """
        SELECT o.o_orderkey eid, CASE WHEN r.r_regionkey < 2 THEN 'A' ELSE 'B' END dom,
               r.r_name f, n.n_name sf
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
          JOIN nation n ON n.n_nationkey = c.c_nationkey
          JOIN region r ON r.r_regionkey = n.n_regionkey
        WHERE o.o_orderkey % 11 <> 0"""
    c["ap"] = f"""
        SELECT p.eid, p.yr, p.pt IN ('ar','cp','re') core, au.auid, au.seq, au.n,
               CASE WHEN p.srcid < 7 THEN 1 ELSE 0 END d,
               coalesce(cnt.ws, 0) ws, coalesce(cnt.ns, 0) ns, coalesce(cnt.dc, 0) dc,
               CASE WHEN p.pt IN ('ar','cp','re') THEN cls.sf END sf, cls.f f
        FROM paper p JOIN au ON au.eid = p.eid AND au.auid > 4
          LEFT JOIN cnt ON cnt.eid = p.eid LEFT JOIN cls ON cls.eid = p.eid
        WHERE p.yr <= {run.max_year} {scope}"""
    c["sized"] = """
        SELECT *, sum(CASE WHEN core THEN 1 ELSE 0 END) OVER (PARTITION BY auid) n_core,
               count(*) OVER (PARTITION BY auid) n_all, count(f) OVER (PARTITION BY auid) n_f
        FROM ap"""
    c["elig"] = "SELECT * FROM sized WHERE n_core >= 5"
    # sums of 1/n are rounded before they are compared: see the tolerance of hm
    c["pos"] = """
        SELECT *, rank() OVER (PARTITION BY auid ORDER BY ns DESC, eid) ns_r,
               rank() OVER (PARTITION BY auid ORDER BY ws DESC, eid) ws_r,
               sum(1.0 / n) OVER (PARTITION BY auid ORDER BY ns DESC, eid) ns_e,
               sum(1.0 / n) OVER (PARTITION BY auid ORDER BY ws DESC, eid) ws_e
        FROM elig"""
    sums = [
        "count(*) np",
        f"CAST(sum(CASE WHEN {in_range} THEN 1 ELSE 0 END) AS BIGINT) np_range",
        "CAST(sum(d) AS BIGINT) np_d",
        f"CAST(sum(CASE WHEN {in_range} THEN d ELSE 0 END) AS BIGINT) np_range_d",
        "CAST(sum(dc) AS BIGINT) ws_nc_d",
    ]
    for b in ("ns", "ws"):
        sums += [
            f"CAST(sum({b}) AS BIGINT) {b}_nc",
            f"CAST(sum(CASE WHEN {b} > 0 THEN 1 ELSE 0 END) AS BIGINT) {b}_npc",
            f"CAST(sum(CASE WHEN {b} > 0 AND {in_range} THEN 1 ELSE 0 END) AS BIGINT) {b}_npc_range",
            f"max(CASE WHEN {b}_r <= {b} THEN {b}_r ELSE 0 END) {b}_h",
            f"round(max(CASE WHEN {b}_e <= {b} + 1e-9 THEN {b}_e ELSE 0.0 END), 9) {b}_hm",
        ]
        for tag, where in (
            ("s", "n = 1"),
            ("sf", "(n = 1 OR seq = 1)"),
            ("sfl", "(n = 1 OR seq = 1 OR seq = n)"),
        ):
            sums += [
                f"CAST(sum(CASE WHEN {where} THEN 1 ELSE 0 END) AS BIGINT) {b}_np{tag}",
                f"CAST(sum(CASE WHEN {where} THEN {b} ELSE 0 END) AS BIGINT) {b}_nc{tag}",
            ]
    c["metrics"] = f"SELECT auid, {', '.join(sums)} FROM pos WHERE {kept} GROUP BY auid"
    c["citing"] = f"""
        SELECT a.auid, count(DISTINCT CASE WHEN e.self = 0 THEN e.citing END) ns_cp,
               count(DISTINCT e.citing) ws_cp
        FROM elig a JOIN edges e ON e.cited = a.eid WHERE {kept.replace('yr', 'a.yr')} GROUP BY a.auid"""
    for level, col in (("sub", "sf"), ("fld", "f")):
        c[f"{level}_n"] = f"""
            SELECT DISTINCT auid, {col} s, n_f, yr, count(*) OVER (PARTITION BY auid, {col}) n_mine,
                   count(*) OVER (PARTITION BY {col}) n_over FROM elig"""
        c[f"{level}_rank"] = f"""
            SELECT DISTINCT auid, s, n_mine, n_over, n_f, r FROM (
              SELECT *, dense_rank() OVER (PARTITION BY auid ORDER BY s IS NULL, n_mine DESC,
                     n_over ASC, s ASC) r FROM {level}_n) x WHERE {kept}"""
        c[f"{level}_pick"] = f"""
            SELECT auid, CASE WHEN n_f >= 1 THEN s END s,
                   CASE WHEN n_f >= 1 THEN n_mine / CAST(n_f AS DOUBLE) END frac,
                   row_number() OVER (PARTITION BY auid ORDER BY r) i FROM {level}_rank"""
    c["main"] = """
        SELECT a.auid, a.s subfield_1, a.frac subfield_1_frac, b.s subfield_2,
               b.frac subfield_2_frac, f.s field_1, f.frac field_1_frac
        FROM sub_pick a LEFT JOIN sub_pick b ON b.auid = a.auid AND b.i = 2
          LEFT JOIN fld_pick f ON f.auid = a.auid AND f.i = 1
        WHERE a.i = 1"""
    logs = ", ".join(f"ln({b}_{m} + 1) {b}_l{m}" for b in ("ns", "ws") for m in MEASURES)
    c["prof"] = f"""
        SELECT m.*, coalesce(k.ns_cp, 0) ns_cp, coalesce(k.ws_cp, 0) ws_cp, {logs}
        FROM metrics m LEFT JOIN citing k ON k.auid = m.auid"""
    maxima = ", ".join(f"max({b}_l{m}) {b}_m{m}" for b in ("ns", "ws") for m in MEASURES)
    c["mx"] = f"SELECT {maxima} FROM prof"
    fracs = ", ".join(
        f"{b}_l{m} / nullif((SELECT {b}_m{m} FROM mx), 0) {b}_f{m}"
        for b in ("ns", "ws") for m in MEASURES
    )
    c["fr"] = f"SELECT *, {fracs} FROM prof"
    totals = ", ".join(
        " + ".join(f"{b}_f{m}" for m in MEASURES) + f" {b}_c" for b in ("ns", "ws")
    )
    c["scored"] = f"""
        SELECT *, {totals}, (ws_nc - ns_nc) / CAST(nullif(ws_nc, 0) AS DOUBLE) self_share,
               ns_nc / CAST(nullif(ns_cp, 0) AS DOUBLE) ns_ratio,
               ws_nc / CAST(nullif(ws_cp, 0) AS DOUBLE) ws_ratio FROM fr"""
    c["nm"] = f"""
        SELECT auid, eid name_eid,
               coalesce(surname || ', ' || coalesce(given, initials), pref, idx) authfull, lo, hi
        FROM (
          SELECT au.auid, p.eid,
                 CASE WHEN p.eid % 4 <> 0 THEN 'G' || (p.eid % 9) END given,
                 CASE WHEN t.p_size % 11 <> 0 THEN t.p_name END surname,
                 CASE WHEN t.p_size % 3 <> 0 THEN 'I.' END initials,
                 CASE WHEN t.p_size % 5 <> 0 THEN t.p_name || ' P' END pref,
                 t.p_name || ' X' idx,
                 row_number() OVER (PARTITION BY au.auid ORDER BY
                   CASE WHEN p.eid % 4 <> 0 THEN 1 ELSE 0 END DESC, p.ds DESC, p.eid DESC,
                   au.seq DESC) r,
                 min(p.yr) OVER (PARTITION BY au.auid) lo, max(p.yr) OVER (PARTITION BY au.auid) hi
          FROM au JOIN paper p ON p.eid = au.eid
            JOIN part t ON t.p_partkey = CASE WHEN au.auid >= {SPLIT} THEN au.auid // {SPLIT} - 1 ELSE au.auid END) x
        WHERE r = 1"""
    c["links"] = f"""
        SELECT DISTINCT l.l_orderkey eid, {author} auid, l.l_suppkey afid, p.yr, p.ds,
               'Dept ' || (l.l_orderkey % 3) || ', ' || s.s_name printed, n.n_name cntry
        FROM lineitem l JOIN paper p ON p.eid = l.l_orderkey
          JOIN supplier s ON s.s_suppkey = l.l_suppkey
          JOIN nation n ON n.n_nationkey = s.s_nationkey
        WHERE l.l_suppkey % 9 <> 0"""
    c["last"] = """
        SELECT * FROM (SELECT *, rank() OVER (PARTITION BY auid ORDER BY yr DESC) yrk FROM links) x
        WHERE yrk = 1"""
    c["aff"] = """
        SELECT auid, afid, count(*) n, max(ds) mx FROM last GROUP BY auid, afid"""
    c["inst"] = """
        SELECT a.auid, a.afid affil_id, w.printed affil_name, w.cntry, a.mx max_datesort,
               CASE WHEN a.afid % 4 <> 0 THEN 'Inst ' || s.s_name END preferred_name,
               coalesce(CASE WHEN a.afid % 4 <> 0 THEN 'Inst ' || s.s_name END, w.printed) inst_name
        FROM (SELECT *, row_number() OVER (PARTITION BY auid ORDER BY n DESC, mx DESC, afid) r
              FROM aff) a
          JOIN (SELECT *, row_number() OVER (PARTITION BY auid, afid ORDER BY ds DESC, eid DESC) q
                FROM last) w ON w.auid = a.auid AND w.afid = a.afid AND w.q = 1
          JOIN supplier s ON s.s_suppkey = a.afid
        WHERE a.r = 1"""
    c["rk"] = """
        SELECT s.*, m.* EXCLUDE (auid), nm.* EXCLUDE (auid), i.* EXCLUDE (auid),
               rank() OVER (ORDER BY ns_c DESC NULLS LAST) ns_rank,
               rank() OVER (ORDER BY ws_c DESC NULLS LAST) ws_rank,
               CASE WHEN subfield_1 IS NOT NULL THEN
                 rank() OVER (PARTITION BY subfield_1 ORDER BY ns_c DESC NULLS LAST) END ns_srank,
               CASE WHEN subfield_1 IS NOT NULL THEN
                 rank() OVER (PARTITION BY subfield_1 ORDER BY ws_c DESC NULLS LAST) END ws_srank,
               CASE WHEN subfield_1 IS NOT NULL THEN
                 count(*) OVER (PARTITION BY subfield_1) END s_count
        FROM scored s LEFT JOIN main m ON m.auid = s.auid LEFT JOIN nm ON nm.auid = s.auid
          LEFT JOIN inst i ON i.auid = s.auid
        WHERE s.np_range >= 2"""
    c["ranked"] = f"""
        SELECT *, coalesce(ws_rank <= {run.cutoff} OR ns_rank <= {run.cutoff}
                 OR ws_srank / CAST(s_count AS DOUBLE) <= {run.fraction}
                 OR ns_srank / CAST(s_count AS DOUBLE) <= {run.fraction}, FALSE) top FROM rk"""
    for level, col in (("subfield", "subfield_1"), ("field", "field_1"), ("total", "'TOTAL'")):
        c[f"thr_{level}"] = _threshold_sql(col, run)
    c["lab"] = """
        SELECT CASE WHEN r.r_regionkey < 2 THEN 'A' ELSE 'B' END dom, r.r_name f, n.n_name sf
        FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey"""
    return c


WIDE = (25, 50, 75, 90, 95, 99)
HIGH = (95, 99)
THRESHOLDS = (
    ("cites", "ws_nc", WIDE, False),
    ("c", "ws_c", WIDE, False),
    ("self_share", "self_share", HIGH, False),
    ("cite_ratio", "ws_ratio", HIGH, False),
    ("cite_ratio_ns", "ns_ratio", HIGH, False),
    ("top_self_share", "self_share", HIGH, True),
    ("top_cite_ratio", "ws_ratio", HIGH, True),
    ("top_cite_ratio_ns", "ns_ratio", HIGH, True),
)


def _threshold_sql(subject: str, run: Run) -> str:
    """Inverse rank positions by plain windows, then the least value past each point."""
    windows, cuts, reached = [], [], []
    for name, col, points, top in THRESHOLDS:
        part = "subj, top" if top else "subj"
        windows.append(f"count({col}) OVER (PARTITION BY {part}) n_{name}")
        windows.append(
            f"rank() OVER (PARTITION BY {part} ORDER BY {col} DESC NULLS LAST) r_{name}"
        )
        for p in points:
            at = f"(n_{name} - (r_{name} - 1)) / CAST(nullif(n_{name}, 0) AS DOUBLE) >= {p / 100}"
            if top:
                at = f"top AND {at}"
            value = f"min(CASE WHEN {at} THEN {col} END)"
            cuts.append(f"{value} {name}_{p}")
            if top:
                reached.append(f"count(CASE WHEN {at} THEN 1 END) n_{name}_{p}")
    return f"""
        SELECT subj subject, count(*) n_authors,
               count(CASE WHEN ns_rank <= {run.cutoff} THEN 1 END) n_top_rank_ns,
               count(CASE WHEN ws_rank <= {run.cutoff} THEN 1 END) n_top_rank,
               nullif(count(CASE WHEN top THEN 1 END), 0) n_top_list,
               {', '.join(cuts + reached)}
        FROM (SELECT *, {', '.join(windows)} FROM (SELECT *, {subject} subj FROM ranked) s) w
        GROUP BY subj"""


def _rounded_thresholds(source: str) -> str:
    floating = ", ".join(
        f"round({name}_{p}, 6) AS {name}_{p}"
        for name, col, points, _ in THRESHOLDS if col != "ws_nc" for p in points
    )
    return f"SELECT * REPLACE ({floating}) FROM {source}"


def _needed(name: str, ctes: dict[str, str], found: dict[str, None]) -> None:
    """Collect the named block and every block its text mentions, dependencies first."""
    words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in ctes[name]).split())
    for other in ctes:
        if other != name and other in words and other not in found:
            before = list(ctes)
            if before.index(other) < before.index(name):
                _needed(other, ctes, found)
    found[name] = None


def _sql(body: str, run: Run = _RUN) -> str:
    ctes = _ctes(run)
    words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in body).split())
    found: dict[str, None] = {}
    for name in ctes:
        if name in words and name not in found:
            _needed(name, ctes, found)
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n].strip()})" for n in found)
    return f"WITH {blocks}\n{body}" if blocks else body


def _pct(expr: str, unit: str) -> str:
    return f"CAST(round(({expr}) * 100, 2) AS VARCHAR) || '{unit}'"


_RENAMED = {
    "np_discontinued": "np_d",
    "np_range_discontinued": "np_range_d",
    "ws_nc_discontinued": "ws_nc_d",
    "ns_nc_citing": "ns_cp",
    "ws_nc_citing": "ws_cp",
    "ns_cite_ratio": "ns_ratio",
    "ws_cite_ratio": "ws_ratio",
    "ns_subfield_rank": "ns_srank",
    "ws_subfield_rank": "ws_srank",
    "subfield_count": "s_count",
    "first_pub_year": "lo",
    "last_pub_year": "hi",
    "author_id": "auid",
}
_DOUBLES = {
    "ns_hm", "ws_hm", "ns_c", "ws_c", "self_share", "ns_cite_ratio", "ws_cite_ratio",
    "subfield_1_frac", "subfield_2_frac", "field_1_frac",
}


def _cols(*names: str) -> str:
    parts = []
    for name in names:
        source = _RENAMED.get(name, name)
        parts.append(f"round({source}, 6) {name}" if name in _DOUBLES else f"{source} {name}")
    return ", ".join(parts)


def _both(*names: str) -> list[str]:
    return [f"{b}_{n}" for b in ("ns", "ws") for n in names]


def _table1_sql(numeric: bool, run: Run = _RUN) -> str:
    y0, y1, y2 = run.years

    def basis(b: str) -> list[tuple[str, str]]:
        tail = " (ns)" if b == "ns" else ""
        return [(label + tail, source) for label, source in (
            ("rank", f"{b}_rank"), (f"nc{y1}{y2}", f"{b}_nc"), (f"h{y2}", f"{b}_h"),
            (f"hm{y2}", f"round({b}_hm, 6)"), ("nps", f"{b}_nps"), ("ncs", f"{b}_ncs"),
            ("npsf", f"{b}_npsf"), ("ncsf", f"{b}_ncsf"), ("npsfl", f"{b}_npsfl"),
            ("ncsfl", f"{b}_ncsfl"), ("c", f"round({b}_c, 6)"), ("npciting", f"{b}_cp"),
            ("cprat", f"round({b}_ratio, 6)"), (f"np{y0}{y2} cited{y1}{y2}", f"{b}_npc_range"),
        )]

    share = "round(round(self_share * 100, 2) / 100, 6)" if numeric else _pct("self_share", " %")
    year = "CAST({} AS BIGINT)" if numeric else "{}"
    columns = [
        ("author_id", "auid"), ("authfull", "replace(authfull, '\"', '')"),
        ("inst_name", "replace(inst_name, '\"', '')"), ("cntry", "cntry"),
        (f"np{y0}{y2}", "np_range"), ("firstyr", year.format("lo")), ("lastyr", year.format("hi")),
        *basis("ns"), ("self%", share), *basis("ws"),
        (f"np{y0}{y2}_d", "np_range_d"), (f"nc{y1}{y2}_d", "ws_nc_d"),
        ("sm-subfield-1", "subfield_1"), ("sm-subfield-1-frac", "round(subfield_1_frac, 6)"),
        ("sm-subfield-2", "subfield_2"), ("sm-subfield-2-frac", "round(subfield_2_frac, 6)"),
        ("sm-field", "field_1"), ("sm-field-frac", "round(field_1_frac, 6)"),
        ("rank sm-subfield-1", "ws_srank"), ("rank sm-subfield-1 (ns)", "ns_srank"),
        ("sm-subfield-1 count", "s_count"),
    ]
    return "SELECT " + ", ".join(f'{s} "{n}"' for n, s in columns) + " FROM ranked WHERE top"


def _table2_sql(level: str, numeric: bool = False) -> str:
    def share(part: str) -> str:
        value = f"{part} / CAST(n_authors AS DOUBLE)"
        return f"round(round({value} * 100, 2) / 100, 6)" if numeric else _pct(value, "%")

    def self_share(p: int) -> str:
        value = f"top_self_share_{p}"
        return f"round(round({value} * 100, 2) / 100, 6)" if numeric else _pct(value, " %")

    columns = [
        ("#Auth", "n_authors"), ("#Auth top 100 (ns)", "n_top_rank_ns"),
        ("% in 100 (ns)", share("n_top_rank_ns")), ("#Auth top 100", "n_top_rank"),
        ("% in 100", share("n_top_rank")), ("#Auth in top-list", "n_top_list"),
        ("% in top-list", share("n_top_list")),
        *[(f"Cites@{p}", f"cites_{p}") for p in WIDE],
        *[(f"c@{p}", f"round(c_{p}, 3)") for p in WIDE],
        *[(f"top-list self%@{p}", self_share(p)) for p in HIGH],
        *[(f"top-list cprat@{p}", f"round(top_cite_ratio_{p}, 6)") for p in HIGH],
        *[(f"top-list cprat@{p} (ns)", f"round(top_cite_ratio_ns_{p}, 6)") for p in HIGH],
    ]
    listed = ", ".join(f'{s} "{n}"' for n, s in columns)
    rows = f"(SELECT * FROM thr_{level} UNION ALL SELECT * FROM thr_total) t"
    name = "coalesce(subject, 'Unassigned')"
    if level == "subfield":
        return (
            f'SELECT lab.dom "Domain", lab.f "Field", {name} "Subfield", {listed} '
            f"FROM {rows} LEFT JOIN lab ON lab.sf = t.subject"
        )
    return (
        f'SELECT l.dom "Domain", {name} "Field", {listed} '
        f"FROM {rows} LEFT JOIN (SELECT DISTINCT dom, f FROM lab) l ON l.f = t.subject"
    )


def _table2_order_sql() -> str:
    last = "CASE WHEN {0} = 'TOTAL' THEN 'ZZ' ELSE {0} END"
    by = {
        "Subfield": f"""coalesce("Domain", 'ZZ'), "Field" NULLS FIRST, {last.format('"Subfield"')}""",
        "Field": f"""coalesce("Domain", 'ZZ'), {last.format('"Field"')}""",
    }
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, row_number() OVER (ORDER BY {order}) AS position, "
        f'"{level}" AS subject FROM ({_table2_sql(level.lower())}) {level.lower()}_rows'
        for level, order in by.items()
    )


def oracle_sql() -> dict[str, str]:
    m = _both
    sql: dict[str, str] = {
        "citation_edges": "SELECT citing citing_eid, cited cited_eid, disc is_discontinued FROM edges",
        "self_citations": "SELECT citing citing_eid, cited cited_eid FROM edges WHERE self = 1",
        "heavy_references": f"SELECT r.cited cited_eid, count(*) n_references FROM refs r "
        f"JOIN paper a ON a.eid = r.citing WHERE a.yr >= 1997 AND a.coll IN {COUNTED} "
        "AND r.cited IS NOT NULL GROUP BY r.cited HAVING count(*) > 20",
        "citation_counts": "SELECT eid, ws ws_cites, selfs self_cites, ns ns_cites, "
        "dc discontinued_cites FROM cnt",
        "authorship": "SELECT eid, auid, seq author_seq, n n_authors FROM au WHERE auid > 4",
        "counted_publications": f"SELECT eid, yr AS year, pt publication_type FROM paper "
        f"WHERE yr <= 2000 AND coll IN {COUNTED}",
        "publications_by_year": f"SELECT eid, yr AS year FROM paper "
        f"WHERE yr >= 1997 AND coll IN {COUNTED}",
        "author_papers": "SELECT eid, yr AS year, core is_core, d is_discontinued, ws ws_cites, "
        "ns ns_cites, dc discontinued_cites, sf subfield, f field, n n_authors, auid, "
        "seq author_seq FROM ap",
        "core_author_filter": "SELECT DISTINCT auid, n_all n_rows, CAST(n_core AS BIGINT) n_core "
        "FROM elig",
        "paper_counts": f"SELECT auid, {_cols('np', 'np_range', *m('npc', 'npc_range'))} FROM metrics",
        "citation_totals": f"SELECT auid, {_cols(*m('nc'))} FROM metrics",
        "distinct_citing": "SELECT auid, ns_cp ns_nc_citing, ws_cp ws_nc_citing FROM citing",
        "h_index": f"SELECT auid, {_cols(*m('h'))} FROM metrics",
        "hm_index": f"SELECT auid, {_cols(*m('hm'))} FROM metrics",
        "position_metrics": "SELECT auid, "
        + _cols(*m("nps", "ncs", "npsf", "ncsf", "npsfl", "ncsfl")) + " FROM metrics",
        "discontinued_counts": "SELECT auid, "
        + _cols("np_discontinued", "np_range_discontinued", "ws_nc_discontinued")
        + " FROM metrics",
        "label_resolution": "SELECT eid, dom AS domain, f field, sf subfield FROM cls",
        "subject_volumes": "SELECT 'subfield' AS level, sf subject, count(*) n_overall FROM elig "
        "GROUP BY sf UNION ALL SELECT 'field', f, count(*) FROM elig GROUP BY f",
        "subject_ranking": " UNION ALL ".join(
            f"SELECT auid, '{level}' AS level, CAST(r AS INTEGER) AS rank, s subject, "
            "n_mine n_author, n_over n_overall, n_f n_classified, "
            f"round(n_mine / CAST(nullif(n_f, 0) AS DOUBLE), 6) fraction FROM {table}"
            for level, table in (("subfield", "sub_rank"), ("field", "fld_rank"))
        ),
        "main_subjects": "SELECT auid, "
        + _cols("subfield_1", "subfield_1_frac", "subfield_2", "subfield_2_frac", "field_1",
                "field_1_frac") + " FROM main",
        "author_names": "SELECT auid, name_eid, authfull, lo first_pub_year, hi last_pub_year FROM nm",
        "author_institution": "SELECT auid, affil_id, affil_name, cntry, max_datesort, "
        "preferred_name, inst_name FROM inst",
        "log_maxima": "SELECT " + ", ".join(
            f"round({b}_m{x}, 6) {b}_max_log_{x}" for b in ("ns", "ws") for x in MEASURES
        ) + " FROM mx",
        "composite_score": "SELECT auid, " + ", ".join(
            f"round({b}_f{x}, 6) {b}_frac_{x}" for b in ("ns", "ws") for x in MEASURES
        ) + ", round(ns_c, 6) ns_c, round(ws_c, 6) ws_c FROM scored",
        "ratios": f"SELECT auid, {_cols('self_share', 'ns_cite_ratio', 'ws_cite_ratio')} FROM scored",
        "global_rank": "SELECT auid author_id, ns_rank, ws_rank FROM ranked",
        "subfield_rank": "SELECT "
        + _cols("author_id", *m("subfield_rank"), "subfield_count") + " FROM ranked",
        "ranked_authors": "SELECT " + _cols(
            "author_id", "np", "np_range", "np_discontinued", "np_range_discontinued",
            "ws_nc_discontinued",
            *m("nc", "npc", "npc_range", "nps", "ncs", "npsf", "ncsf", "npsfl", "ncsfl", "h", "hm",
               "nc_citing", "c", "cite_ratio", "rank", "subfield_rank"),
            "self_share", "subfield_count", "subfield_1", "subfield_1_frac", "subfield_2",
            "subfield_2_frac", "field_1", "field_1_frac", "name_eid", "authfull",
            "first_pub_year", "last_pub_year", "affil_id", "affil_name", "cntry", "max_datesort",
            "preferred_name", "inst_name",
        ) + ", n_core FROM ranked JOIN (SELECT DISTINCT auid k, CAST(n_core AS BIGINT) n_core "
        "FROM elig) q ON q.k = ranked.auid",
        "top_list": "SELECT auid author_id FROM ranked WHERE top",
        "thresholds_subfield": _rounded_thresholds(
            "(SELECT * FROM thr_subfield UNION ALL SELECT * FROM thr_total) t"
        ),
        "thresholds_field": _rounded_thresholds(
            "(SELECT * FROM thr_field UNION ALL SELECT * FROM thr_total) t"
        ),
        "thresholds_total": _rounded_thresholds("thr_total"),
        "table1": _table1_sql(numeric=False),
        "table1_order": "SELECT row_number() OVER (ORDER BY ns_rank, auid) AS position, "
        "auid author_id FROM ranked WHERE top",
        "table2_order": _table2_order_sql(),
        "table2_subfield": _table2_sql("subfield"),
        "table2_field": _table2_sql("field"),
        "table3": "SELECT " + ", ".join(
            f'round({b}_m{x}, 6) "{label}{tail}"'
            for b, tail in (("ws", ""), ("ns", " (ns)"))
            for x, label in zip(MEASURES, ("nc9700", "h00", "hm00", "ncs", "ncsf", "ncsfl"))
        ) + " FROM mx",
        "typed_report": _table2_sql("subfield", numeric=True),
        "typed_table2_field": _table2_sql("field", numeric=True),
        "read_institutions": "SELECT s_suppkey afid, 'Inst ' || s_name preferred_name FROM supplier "
        "WHERE s_suppkey % 4 <> 0",
        "read_labels": "SELECT dom AS domain, f field, sf subfield FROM lab",
        "read_discontinued": "SELECT CAST(n_nationkey AS BIGINT) srcid FROM nation WHERE n_nationkey < 7",
        "dataset_stats": _dataset_stats_sql(_RUN),
        "ratio_distribution": """
            SELECT subfield_1, auid author_id, round(ws_ratio, 6) ws_cite_ratio,
                   round(pos, 6) ratio_position, ws_nc, ws_cp ws_nc_citing, top top_listed
            FROM (SELECT *, rank() OVER (PARTITION BY subfield_1 ORDER BY ws_ratio)
                    / CAST(count(*) OVER (PARTITION BY subfield_1) AS DOUBLE) pos
                  FROM ranked WHERE subfield_1 IS NOT NULL AND ws_ratio IS NOT NULL) x
            WHERE ws_ratio < 4""",
        "uniqueness_check": """
            SELECT count(*) n_rows, count(CASE WHEN n > 1 THEN 1 END) n_repeated_rows
            FROM (SELECT count(*) OVER (PARTITION BY auid) n FROM inst) x""",
        "run_summary": "SELECT count(*) n_authors, count(field_1) n_authors_with_field FROM ranked",
        "report_roundtrip": _table1_sql(numeric=True),
        "stage_roundtrip": "SELECT eid, ws ws_cites, selfs self_cites, ns ns_cites, "
        "dc discontinued_cites FROM cnt",
    }
    sql["typed_table3"] = sql["table3"]
    built = {name: _sql(body) for name, body in sql.items()}
    built |= {f"{name}_hot": built[name] for name in HOT}
    built["table1_single_year"] = _sql(_table1_sql(False, _SINGLE), _SINGLE)
    built["table2_subfield_single_year"] = _sql(sql["table2_subfield"], _SINGLE)
    built["strict_self_citations"] = _sql(sql["self_citations"], replace(_RUN, strict=True))
    built["max_cite_year"] = _sql(sql["citation_counts"], replace(_RUN, max_cite=1999))
    built["with_preprints"] = _sql(sql["paper_counts"], replace(_RUN, preprints=True))
    built["overall_lower_year"] = _sql(
        "SELECT auid, np, np_range, "
        + _cols(*m("nc", "h", "hm", "nps", "ncsfl", "npc", "nc_citing")) + " FROM prof",
        _LOWER,
    )
    return built


def _dataset_stats_sql(run: Run) -> str:
    best = f"ws_srank / CAST(s_count AS DOUBLE) <= {run.fraction}"
    ns = "ns_srank / CAST(s_count AS DOUBLE)"
    return f"""
        SELECT *, round(auths_top5p_ws_not_ns / CAST(nullif(auths_top5p_ws, 0) AS DOUBLE), 6)
                 x1_fraction_5p_ws_5p_ns_dropout,
               round(auths_top5p_ws_not_top_10p_ns / CAST(nullif(auths_top5p_ws, 0) AS DOUBLE), 6)
                 x2_fraction_5p_ws_10p_ns_dropout,
               round("x3_cprat_above_p99_top-list"
                 / CAST(nullif(toplist_count_w_subfield_w_ws_cprat, 0) AS DOUBLE), 6)
                 x3_fraction_above_p99
        FROM (
          SELECT count(*) totalcount, count(CASE WHEN top THEN 1 END) toplist_count,
                 count(CASE WHEN top THEN subfield_1 END) toplist_count_w_subfield,
                 count(CASE WHEN {best} THEN 1 END) auths_top5p_ws,
                 count(CASE WHEN {best} AND {ns} > {run.fraction} THEN 1 END) auths_top5p_ws_not_ns,
                 count(CASE WHEN {best} AND {ns} > 0.1 THEN 1 END) auths_top5p_ws_not_top_10p_ns,
                 count(CASE WHEN top AND ws_ratio >= p99 THEN 1 END) "x3_cprat_above_p99_top-list",
                 count(CASE WHEN top AND subfield_1 IS NOT NULL THEN ws_ratio END)
                   toplist_count_w_subfield_w_ws_cprat
          FROM ranked LEFT JOIN (
            SELECT subfield_1 lim_sf, min(ws_ratio) p99 FROM (
              SELECT subfield_1, ws_ratio,
                     rank() OVER (PARTITION BY subfield_1 ORDER BY ws_ratio DESC) r,
                     count(*) OVER (PARTITION BY subfield_1) n
              FROM ranked WHERE top AND ws_ratio IS NOT NULL AND subfield_1 IS NOT NULL) y
            WHERE (n - (r - 1)) / CAST(n AS DOUBLE) >= 0.99 GROUP BY subfield_1) lim
          ON lim_sf = subfield_1) z"""
