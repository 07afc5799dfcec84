"""Secrets in texts, and whether each is one owner's or copied everywhere.

Candidates are found by patterns. Each candidate value is hashed, and the hashes are counted
over the whole corpus by distinct owners and repositories: a value that many owners share is
an example from some manual, one that few have looks live. Base kinds are always reported;
of the generic kind `owned`, long tokens of mixed characters without a keyword, only values
that few owners have. What an assignment has matched, its keyword and value, is no such token.

Everything is DataFrame functions. Positions come from the gaps between matches: a text
split by a pattern gives what lies between, so running sums of lengths give starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, spread_join
from laurel.llm.tables import id_of

# What counts as a candidate, as (kind, pattern, group that holds the value).
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
KINDS = (
    ("assign", ASSIGN, 1),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    # an assignment is matched first and then holds no group 2; = only ends a token, as padding
    ("owned", ASSIGN + r"|(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}={0,2})", 2),
)
BASE = ("assign", "access", "hex")

KEY = ["id", "h", "owner", "repository"]


def _found(kind: int, text: Column) -> Column:
    """Matches of one kind in order: what lies before each, the match and its value."""
    _, pattern, group = KINDS[kind]
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    return F.transform(parts, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"),
        F.length(x["match"]).alias("size"), x["value"].alias("value")))


def _counts(kind: Column, value: Column) -> Column:
    """Whether a match is a candidate."""
    mixed = (F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[a-z]"))
             & F.regexp_like(value, F.lit("[A-Z]")))
    return (F.when(kind == 0, F.length(value) >= 12).when(kind == 3, mixed).otherwise(F.lit(True)))


def keyed(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """(id, h, owner, repository, text): what tells rows apart, whatever else they hold."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]
    return docs.select(
        id_of().alias("id"), F.xxhash64("text").alias("h"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.concat_ws("\x1f", *named).alias("repository"), F.coalesce("text", F.lit("")).alias("text"))


def candidates(docs: DataFrame, owner: str = "source", repository: list[str] | None = None) -> DataFrame:
    """One row for each candidate in each text: key columns, kind number, start, stop, value_hash.

    Repeated rows count once. start and stop are code points, stop exclusive.
    """
    rows = keyed(docs, owner, repository or ["source", "lang"])
    some = reduce(lambda a, b: a | b, [F.regexp_like("text", F.lit(p)) for _, p, _ in KINDS[:3]])
    mixed = F.regexp_like("text", F.lit(KINDS[3][1]))
    rows = rows.filter(some | mixed).dropDuplicates(KEY)
    found = F.concat(*[_found(k, F.col("text")) for k in range(len(KINDS))])
    found = rows.select(*KEY, F.explode(found).alias("x")).select(*KEY, "x.*").filter("size is not null")
    so_far = (Window.partitionBy(*KEY, "kind").orderBy("i")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far))
    found = found.filter(_counts(F.col("kind"), F.col("value")))
    return found.select(*KEY, "kind", (F.col("stop") - F.col("size")).alias("start"), "stop",
                        F.sha2("value", 256).alias("value_hash"))


def ownership(found: DataFrame) -> DataFrame:
    """For each value_hash: n occurrences, distinct owners and repositories."""
    once = found.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = once.groupBy("value_hash", "owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def judged(docs: DataFrame, shared_by: int = 3, hot_limit: int = 10_000, owner: str = "source",
           repository: list[str] | None = None) -> DataFrame:
    """Reported spans: candidates with their owners and repositories, and live.

    A value is live if fewer than `shared_by` owners have it.
    """
    found = candidates(docs, owner, repository)
    owned = ownership(found)
    hot = hot_keys(owned, ["value_hash"], "n", hot_limit)
    all_ = spread_join(found, owned.drop("n"), ["value_hash"], hot, "h")
    live = F.col("owners") < shared_by
    return all_.withColumn("live", live).filter((F.col("kind") < len(BASE)) | F.col("live"))


def scan(docs: DataFrame, shared_by: int = 3, hot_limit: int = 10_000, owner: str = "source",
         repository: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, found.

    found lists the spans as (start, stop, kind, live, owners, repositories), in the order of start and then kind.
    A missing or empty text has none; a missing owner or repository is one of its own, named
    ''. Columns beyond doc_id, text and those two are not read.
    """
    name = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), (F.col("kind") + 1).cast("int"))
    spans = judged(docs, shared_by, hot_limit, owner, repository).withColumn("name", name)
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "name", "live", "owners", "repositories")))
    of_text = spans.groupBy(*KEY).agg(listed.alias("found"))
    rows = keyed(docs, owner, repository or ["source", "lang"]).drop("text")
    rows = rows.join(of_text, KEY, "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,name:string,live:boolean,owners:bigint,repositories:bigint>>"))
    rows = rows.withColumn("found", found)

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")

    def count(test) -> Column:
        return F.size(F.filter("found", lambda s: test(s))).cast("long")

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    return rows.select(
        F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"),
        *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(text(F.filter("found", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        F.transform("found", lambda s: F.struct(
            s["start"], s["stop"], s["name"].alias("kind"), s["live"], s["owners"], s["repositories"])).alias("found"),
        "h", "owner", "repository")


def redacted(docs: DataFrame, mark: str = "[secret]", shared_by: int = 3, owner: str = "source",
             repository: list[str] | None = None, shared_repositories: int = 6) -> DataFrame:
    """The documents, each live span replaced by `mark`; shared examples stay. n_chars follows if docs has it.

    An example is what `shared_by` owners or `shared_repositories` repositories have: one owner
    who spreads a value over many repositories does not keep it secret either.
    Overlapping spans are replaced once, from the first start to the last stop.
    """
    names = docs.columns
    repository = repository or ["source", "lang"]
    spans = judged(docs, shared_by, owner=owner, repository=repository)
    spans = spans.filter(F.col("live") & (F.col("repositories") < shared_repositories))
    cuts = F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))))
    cuts = spans.groupBy(*KEY).agg(cuts.alias("_cuts"))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository]
    rows = docs.withColumns({
        "_id": id_of(), "_h": F.xxhash64("text"), "_owner": F.coalesce(F.col(owner).cast("string"), F.lit("")),
        "_repository": F.concat_ws("\x1f", *named)})
    cuts = cuts.withColumnsRenamed({k: f"_{k}" for k in KEY})
    rows = rows.join(cuts, [f"_{k}" for k in KEY], "left")
    # gaps between merged cuts: a gap begins where the furthest stop so far lies before the next start
    reached = F.transform("_cuts", lambda c, i: F.array_max(F.transform(F.slice("_cuts", 1, i + 1), lambda d: d["stop"])))
    pieces = F.transform(F.col("_cuts"), lambda c, i: F.when(
        i == 0, F.concat(F.substring("text", F.lit(1), c["start"]), F.lit(mark))).when(
        c["start"] > F.get(F.col("_reached"), i - 1), F.concat(
            F.substring("text", F.get(F.col("_reached"), i - 1) + 1, c["start"] - F.get(F.col("_reached"), i - 1)),
            F.lit(mark))).otherwise(F.lit("")))
    rest = F.substring("text", F.array_max("_reached") + 1, F.length("text"))
    rows = rows.withColumn("_reached", reached)
    new = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    rows = rows.withColumn("text", new)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)


def oracle(table: str = "documents", shared_by: int = 3) -> str:
    """DuckDB SQL for the digest columns of `scan`."""
    letters = ["password", "passwd", "secret", "token", "api_?key"]
    either = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in letters)
    assign = f"(?:{either})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = [(0, "assign", assign, 1), (1, "access", KINDS[1][1], 0), (2, "hex", KINDS[2][1], 0),
                (3, "owned", "[A-Za-z0-9+/_=-]{20,}", 0)]
    found = "\nUNION ALL\n".join(f"""
  SELECT rid, doc_id, owner, repository, {k} AS kind, '{name}' AS name,
    unnest(range(len(regexp_extract_all(text, '{p}')))) AS i,
    unnest(regexp_extract_all(text, '{p}')) AS hit, unnest(regexp_extract_all(text, '{p}', {g})) AS value,
    unnest(string_split_regex(text, '{p}')[:len(regexp_extract_all(text, '{p}'))]) AS gap
  FROM d WHERE regexp_matches(text, '{p}')""" for k, name, p, g in patterns)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
    coalesce(source, '') || chr(31) || coalesce(lang, '') AS repository FROM {table}),
m AS ({found}),
p AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM m),
c AS (
  SELECT *, stop - length(hit) AS start FROM p
  WHERE CASE kind WHEN 0 THEN length(value) >= 12
    WHEN 3 THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    ELSE true END),
o AS (SELECT value, count(DISTINCT owner) AS owners FROM c GROUP BY value),
s AS (
  SELECT c.rid, kind, name || ':' || start::BIGINT || ':' || stop::BIGINT AS span, start, owners < {shared_by} AS live
  FROM c JOIN o USING (value) WHERE kind < 3 OR owners < {shared_by}),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (live) AS n_live,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (rid)"""
