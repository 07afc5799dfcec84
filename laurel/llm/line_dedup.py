"""Repeated lines over all documents: levelled sorted runs of line fingerprints.

The index is a set of levels, each with some sorted runs; `fanout` runs of a level are
compacted to one run of the next. Documents come in
batches, those with the largest doc_id first. A batch's line keys are sorted into a run of
their own, which is merge-anti-joined with the runs there are: a key that these have settled
(found often enough, in a document with a larger doc_id) needs no further record, the others
are added. Runs and batches have the same buckets and order, so merging never shuffles.

    documents --> fingerprints of each line, written by batch
      --> sorted run of a batch, anti-joined with the runs --> levels
      --> frequent keys --> back to their lines --> back to the texts

Everything is DataFrame functions. A fingerprint has 128 bits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.functions.spread import hot_keys, spread_join
from laurel.llm.tables import NO_ID, id_back, id_of, shared_folder

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ("h", "g")
ROW = ("id", "t", "u")
LEAST_BUCKETS, MOST_BUCKETS = 8, 100_000
SECOND = "second"


def fingerprint(value: Column) -> tuple[Column, Column]:
    """128 bits, as two longs."""
    return F.xxhash64(value), F.xxhash64(F.lit(SECOND), value)


def lower_ascii(value: Column) -> Column:
    """A-Z in lower case and nothing else; `lower` does that where all characters are ASCII."""
    return (F.when(F.octet_length(value) == F.length(value), F.lower(value))
            .otherwise(F.translate(value, UPPER, UPPER.lower())))


def prints(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row for each row of docs: id, two fingerprints of the text, and the lines that can repeat."""
    text = F.coalesce("text", F.lit(""))
    t, u = fingerprint(text)
    keys = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(
        i.alias("pos"), lower_ascii(F.trim(x, F.lit(SPACE))).alias("key")))

    def numbered(x: Column) -> Column:
        h, g = fingerprint(x["key"])
        return F.struct(x["pos"].alias("pos"), h.alias("h"), g.alias("g"))

    lines = F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= least_chars), numbered)
    return docs.select(id_of().alias("id"), t.alias("t"), u.alias("u"), lines.alias("lines"))


def run_of(lines: DataFrame) -> DataFrame:
    """For each key of (h, g, id): in how many documents, the largest id, and how many lines.

    Ids are made distinct first, by key and id, so that a line in every document is no hot group.
    """
    once = lines.groupBy(*KEY, "id").agg(F.count(F.lit(1)).alias("lines"))
    return once.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.sum("lines").alias("lines"))


class Runs:
    """Levels of sorted runs, each row (h, g, n, last, lines): a key, its documents, the largest id, its lines.

    All runs are partitions of one table below `folder`, with the same buckets and order, so that
    any of them are merged and joined without a shuffle. `close` takes its name from the catalog.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name, self.path = f"runs_{uuid.uuid4().hex}", f"{folder}/runs"
        self.written = 0
        self.levels: list[list[int]] = []  # the runs of each level

    def write(self, rows: DataFrame) -> int:
        """A new run of rows that are dealt to the buckets already; its number."""
        (rows.select(*KEY, "n", "last", "lines", F.lit(self.written).alias("run"))
         .write.partitionBy("run").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.path)
         .mode("append").format("parquet").saveAsTable(self.name))
        self.written += 1
        return self.written - 1

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *KEY)

    def read(self, *runs: int) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("run").isin(*runs)).drop("run")

    def merged(self, *runs: int) -> DataFrame:
        """Each key of the runs once; without numbers of all runs that count."""
        runs = runs or tuple(r for level in self.levels for r in level)
        return self.read(*runs).groupBy(*KEY).agg(
            F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("lines").alias("lines"))

    def new_to(self, run: int, settled_at: int) -> DataFrame:
        """What of a written run the others have not settled: a merge-anti-join."""
        rows = self.read(run)
        if not self.levels:
            return rows
        settled = self.merged().filter(F.col("n") >= settled_at).select(*KEY)
        return rows.hint("merge").join(settled, list(KEY), "left_anti")

    def add(self, rows: DataFrame, settled_at: int) -> DataFrame:
        """Add a batch; returns its sorted run, whole. Batches come from the largest ids down."""
        run = self.write(self.dealt(rows))
        self._put(self.write(self.new_to(run, settled_at)), 0)
        return self.read(run)

    def _put(self, run: int, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            run = self.write(self.merged(*self.levels[level]))
            self.levels[level] = []
            self._put(run, level + 1)

    def close(self) -> None:
        """Nothing can be read through this object any more; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """Number of a document's batch, the largest ids in batch 0; bounds are estimated from all ids."""
    parts = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = docs.select(id_of().alias("id")).agg(F.percentile_approx("id", parts or [0.0], 1000).alias("b")).first()["b"]
    out = F.lit(0)
    for bound in (bounds or []) if batches > 1 else []:
        out = out + (F.col("id") < bound).cast("int")
    return out


def _flags(positions: Column) -> Column:
    """Line numbers, sorted, as booleans by line number."""
    at = F.array_sort(positions)
    return F.flatten(F.zip_with(at, F.concat(F.array(F.lit(-1)), at), lambda p, before: F.when(
        p.isNull(), F.array().cast("array<boolean>")).otherwise(
        F.concat(F.array_repeat(F.lit(False), p - before - 1), F.array(F.lit(True))))))


def remove_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, keep_text: bool = True,
                 batches: int = 4, fanout: int = 3, bucket_rows: int = 500_000) -> DataFrame:
    """Of each line found in `least_docs` documents keep those of the largest doc_id.

    A text splits at \\n; a missing or empty one is a single empty line. Lines are compared
    without white space (space, tab to carriage return) at both ends and with A-Z in lower case;
    lines of fewer than `least_chars` code points then stay. All lines of the document that keeps
    a key stay. Rows with equal doc_id count as one document; those without doc_id count as one
    that comes before all others. Other columns are not read. Returns doc_id, n_lines (before),
    n_dropped, kept_sha256 and, if wanted, the kept text, for every row.

    `batches` is the number of runs the documents are dealt to, `bucket_rows` the number of lines
    that one bucket of the index is meant for.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    found = prints(docs, least_chars)
    found.withColumn("batch", _batch_of(docs, batches)).write.partitionBy("batch").parquet(f"{folder}/prints")
    schema = found.schema.add("batch", "integer")
    found = spark.read.schema(schema).parquet(f"{folder}/prints")
    total = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines"), F.count(F.lit(1)).alias("rows")).first()
    buckets = min(max(-(-total["lines"] // bucket_rows), LEAST_BUCKETS), MOST_BUCKETS)

    # at most 2,000 keys can have more rows than a two-thousandth of them: the hot lists' bound
    hot_lines, hot_rows = (max(1_000, total[k] // 2_000) for k in ("lines", "rows"))
    lines = found.select(*ROW, "batch", F.explode("lines").alias("x")).select(*ROW, "batch", "x.*")
    runs, heavy = Runs(spark, folder, buckets, fanout), []
    try:
        for k in range(batches):
            run = runs.add(run_of(lines.filter(F.col("batch") == k)), least_docs)
            heavy.append(run.filter(F.col("lines") > hot_lines / batches).select(*KEY, "lines"))
        runs.merged().filter(F.col("n") >= least_docs).select(*KEY, "last").write.parquet(f"{folder}/frequent")
        reduce(DataFrame.unionAll, heavy).write.parquet(f"{folder}/heavy")
    finally:
        runs.close()
    frequent = spark.read.schema("h long, g long, last long").parquet(f"{folder}/frequent")
    counts = (spark.read.schema("h long, g long, lines long").parquet(f"{folder}/heavy")
              .groupBy(*KEY).agg(F.sum("lines").alias("lines")))

    hot = hot_keys(counts, list(KEY), "lines", hot_lines)
    judged = spread_join(lines.drop("batch"), frequent, list(KEY), hot, F.struct("id", "t", "pos"))
    dropped = judged.filter(F.col("id") < F.col("last")).groupBy(*ROW).agg(F.collect_set("pos").alias("at"))
    dropped = dropped.select(*ROW, F.size("at").cast("long").alias("n_dropped"), _flags(F.col("at")).alias("flags"))

    text = F.coalesce("text", F.lit(""))
    t, u = fingerprint(text)
    texts = docs.select(id_of().alias("id"), t.alias("t"), u.alias("u"), text.alias("text"))
    copies = found.groupBy(*ROW).agg(F.count(F.lit(1)).alias("rows"))
    texts = spread_join(texts, dropped, list(ROW), hot_keys(copies, list(ROW), "rows", hot_rows), F.monotonically_increasing_id(), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))), "\n")
    kept = F.when(F.col("flags").isNull(), F.col("text")).otherwise(kept)
    out = texts.select(
        id_back("id").alias("doc_id"), F.size(parts).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), *["kept"] * keep_text)


def oracle() -> str:
    return rf"""
WITH rows AS (
  SELECT row_number() OVER () AS r, coalesce(doc_id, {NO_ID}) AS id, doc_id,
         string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM rows),
keyed AS (
  SELECT r, id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
frequent AS (
  SELECT key, max(id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT id) >= 3),
judged AS (
  SELECT k.r, k.pos, k.line, f.key IS NOT NULL AND k.id < f.last AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key),
kept AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM rows JOIN kept USING (r)
"""
