"""How far the sources of a language differ in their terms, and by which terms.

Terms are counted once for each task and then summed. For each language, terms in enough
documents are kept. Sources are compared in pairs over all kept terms: the terms are dealt to
parts, a part holds the shares of all sources for its terms as a matrix, and adds up one block
of rows of the pair table.

The terms a source uses more than its language come from a dominance skyband. A term goes
before another if its count in the group is as high or higher, its count in the language as
low or lower, and it is earlier in UTF-8: then its value is no lower. So the first k lie
among the terms that fewer than k others dominate. Each task keeps that skyband of its rows,
skybands are merged to one for each group, and only that is ranked, exactly.

    texts --> counts by (lang, source, term) --> kept terms with their sources --> pairs
                                                                             --> skybands --> ranks
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.llm.tables import settled

#: A-Z in lower case, a-z and bytes of other characters as they are, all else white space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FLUSH = 200_000
UNIT = 1_000_000_000
BLOCK = 256
SALTS = 64
COUNTED = "lang string, source string, term string, n long, docs long"
EDGE = ("lang", "source", "term", "n", "all")


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) so far; emptied now and then."""
    held: dict[tuple, dict[bytes, list[int]]] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        columns = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
        for (lang, source), terms in held.items():
            columns["lang"] += [lang] * len(terms)
            columns["source"] += [source] * len(terms)
            columns["term"] += terms
            columns["n"] += [x[0] for x in terms.values()]
            columns["docs"] += [x[1] for x in terms.values()]
        columns["term"] = pa.array(columns["term"], pa.binary()).cast(pa.string())
        held.clear()
        return pa.RecordBatch.from_pydict(columns, schema=pa.schema([
            ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))

    for batch in batches:
        lang, source, text = (batch.column(k) for k in ("lang", "source", "text"))
        for i in range(batch.num_rows):
            terms = held.setdefault((lang[i].as_py(), source[i].as_py()), {})
            size -= len(terms)
            for term, n in Counter(text[i].as_py().translate(TERM_BYTES).split()).items():
                seen = terms.get(term)
                if seen is None:
                    terms[term] = [n, 1]
                else:
                    seen[0] += n
                    seen[1] += 1
            size += len(terms)
            if size >= FLUSH:
                yield rows()
                size = 0
    yield rows()


def group_of() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, term, n, sources): terms in at least `least_docs` documents of the language, and who has them.

    A row is a document. sources holds (source, n), at most one entry for each source of the language.
    """
    texts = docs.select(*group_of(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(count_terms, COUNTED)
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (each.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
        .filter(F.col("docs") >= least_docs).drop("docs"))


def totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group that occurs, with or without kept terms."""
    groups = docs.select(*group_of()).distinct()
    own = (kept.select("lang", F.explode("sources").alias("x"))
           .groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total")))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")])


def share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({UNIT} as decimal(38, 0)) * (cast({n} as decimal(20, 0)) + 2)) "
                  f"div cast({total} + 2 * terms as decimal(38, 0))")


def value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


# ------------------------------------------------------------------ pairs of sources


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """Shares of counts (terms by sources), exact: what overflows 64 bits is worked out in Python integers."""
    if not terms:
        return np.ones_like(n)
    if n.size and int(n.max()) + 2 < 2**63 // UNIT:
        return 1 + UNIT * (n + 2) // (total + 2 * terms)
    exact = 1 + UNIT * (n.astype(object) + 2) // (total.astype(object) + 2 * terms)
    return exact.astype(np.int64)


def add_up(part: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of rows of the pair table of a language, over the terms of one part."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not part.num_rows or not groups.num_rows:
        return schema.empty_table()
    order = sorted(range(groups.num_rows), key=groups.column("source").to_pylist().__getitem__)
    groups = groups.take(order)
    names = groups.column("source").to_pylist()
    total, terms = groups.column("total").to_numpy(), groups.column("terms")[0].as_py()
    number = {s: i for i, s in enumerate(names)}
    first = part.column("block")[0].as_py() * BLOCK
    mine = range(first, min(first + BLOCK, len(names)))
    sums = np.zeros((len(mine), len(names)), np.int64)
    step = max(1, (1 << 20) // len(names))
    for at in range(0, part.num_rows, step):
        sources = part.column("sources").slice(at, step).to_pylist()
        n = np.zeros((len(sources), len(names)), np.int64)
        for i, entries in enumerate(sources):
            for e in entries:
                n[i, number[e["source"]]] = e["n"]
        p = _shares(n, total, terms)
        for k, g in enumerate(mine):
            own = p[:, g:g + 1]
            sums[k] += ((own - p) ** 2 // (own + p)).sum(axis=0)
    source, item = np.repeat(np.array(names, object)[first:first + len(mine)], len(names)), names * len(mine)
    return pa.table([pa.array(groups.column("lang").to_pylist()[:1] * len(item), pa.string()),
                     pa.array(source, pa.string()), pa.array(item, pa.string()), sums.ravel()], schema=schema)


def pairs(kept: DataFrame, groups: DataFrame, part_terms: int = 5_000) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, over all kept terms.

    A task holds BLOCK rows of the pair table and about `part_terms` terms.
    """
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.max("terms").alias("terms"))
    blocks = F.explode(F.sequence(F.lit(0), F.expr(f"(groups - 1) div {BLOCK}").cast("int")))
    part = F.expr(f"pmod(xxhash64(term), 1 + terms div {part_terms})")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a language is a hot key
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(sizes, ["lang", "salt"])
    dealt = salted.select("lang", "sources", part.alias("part"), blocks.alias("block"))
    places = dealt.select("lang", "part", "block").distinct()
    known = places.join(groups, "lang").select("lang", "part", "block", "source", "total", "terms")
    known = known.toDF(*known.columns)  # columns of its own: both sides come from the same terms
    keys = ["lang", "part", "block"]
    summed = (dealt.groupBy(keys).cogroup(known.groupBy(keys))
              .applyInArrow(add_up, "lang string, source string, item string, value long")
              .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    # the result itself: every other source of the language, also where nothing is kept
    named = groups.groupBy("lang").agg(F.collect_list("source").alias("items"))
    all_ = groups.join(named, "lang").select("lang", "source", F.explode("items").alias("item")).filter("source != item")
    return all_.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


# ------------------------------------------------------------------ terms of a source


def skyband(n: list[int], lang_n: list[int], term: list[str], k: int) -> list[int]:
    """Rows that fewer than k others dominate: n as high, lang_n as low, term earlier in UTF-8.

    Rows go in an order in which dominators come first; of those seen, a binary indexed tree over
    lang_n holds the k earliest terms of each range.
    """
    key = [t.encode() for t in term]
    order = sorted(range(len(n)), key=lambda i: (-n[i], lang_n[i], key[i]))
    ranks = {v: r for r, v in enumerate(sorted(set(lang_n)), start=1)}
    tree: list[list[bytes]] = [[] for _ in range(len(ranks) + 1)]
    out = []
    for i in order:
        r, dominators = ranks[lang_n[i]], 0
        while r and dominators < k:
            dominators += bisect_left(tree[r], key[i])
            r &= r - 1
        if dominators >= k:
            continue
        out.append(i)
        r = ranks[lang_n[i]]
        while r < len(tree):
            insort(tree[r], key[i])
            del tree[r][k:]
            r += r & -r
    return out


def _skybands(k: int):
    """The skyband of each (lang, source) in some rows."""

    def of_rows(table: pa.Table) -> pa.Table:
        group: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(table.column("lang").to_pylist(), table.column("source").to_pylist())):
            group.setdefault(key, []).append(i)
        n, lang_n, term = (table.column(c).to_pylist() for c in ("n", "all", "term"))
        keep = []
        for rows in group.values():
            keep += [rows[i] for i in skyband([n[i] for i in rows], [lang_n[i] for i in rows], [term[i] for i in rows], k)]
        return table.take(pa.array(keep, pa.int64()))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            one = of_rows(pa.Table.from_batches([batch]))
            held = one if held is None else pa.concat_tables([held, one])
            if held.num_rows > FLUSH:
                held = of_rows(held)
        if held is not None:
            yield from of_rows(held).combine_chunks().to_batches()

    return of_rows, of_task


def leading_terms(kept: DataFrame, groups: DataFrame, top: int = 10, fan_in: int = 32) -> DataFrame:
    """(lang, source, item, value, rank) of the `top` terms with a share above the language's."""
    rows = kept.select("lang", F.explode("sources").alias("x"), "term", F.col("n").alias("all")).select(
        "lang", "x.source", "term", "x.n", "all")
    schema = "lang string, source string, term string, n long, all long"
    of_rows, of_task = _skybands(top)
    local = rows.mapInArrow(of_task, schema).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(fan_in)))
    merged = local.groupBy("lang", "source", "salt").applyInArrow(lambda t: of_rows(t.select(EDGE)), schema)
    merged = merged.groupBy("lang", "source").applyInArrow(of_rows, schema)
    valued = merged.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("all", "lang_total").alias("q"))
    valued = valued.filter("p > q").select("lang", "source", "item", value("p", "q").alias("value"))
    return _ranked(valued).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, part_terms: int = 5_000) -> DataFrame:
    """Divergence of each source of a language from the others (`pair`) and its own terms (`term`).

    Missing text, lang and source are ''; every row is a document, repeated ones too. A group
    without terms has zero counts for all kept ones; a language without kept terms has pairs of
    value 0. Ties are ordered by UTF-8. Other columns are not read. Returns lang, source, part,
    item, value, rank.
    """
    kept = settled(kept_terms(docs, least_docs))
    groups = settled(totals(docs, kept))
    both = [("pair", _ranked(pairs(kept, groups, part_terms))), ("term", leading_terms(kept, groups, top))]
    pair, term = (df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in both)
    return pair.unionAll(term)


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
words AS (SELECT r, lang, source, translate(unnest(found), '{upper}', '{upper.lower()}') AS term FROM rows),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM rows),
sizes AS (SELECT lang, count(*)::HUGEINT AS terms, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(o.total, 0) + 2 * s.terms) AS p,
         1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.terms) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
