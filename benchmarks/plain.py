"""Library plans against the plain way to write the same query, side by side.

The plain forms gather id lists per author, count by row-level windows and order
all authors in one task. Prints one line per comparison: median of three after a
warm-up, over stages that are already written.
"""

from __future__ import annotations

import os
import statistics
import sys
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import bench
from laurel_registry import tables
from laurel.functions.columns import ratio
from laurel.operators import profile, ranking, subjects, thresholds
from laurel.plans.pipeline import Pipeline
from laurel_registry.scratch import scratch_folder


def plain_citing(p: Pipeline) -> DataFrame:
    lists = p.edges.groupBy(F.col("cited_eid").alias("eid")).agg(
        F.collect_list("citing_eid").alias("ws"),
        F.collect_list(F.when(F.col("is_self") == 0, F.col("citing_eid"))).alias("ns"),
    )
    return p.author_papers.join(lists, "eid", "left").groupBy("auid").agg(*[
        F.size(F.array_distinct(F.flatten(F.collect_list(b)))).alias(b) for b in ("ws", "ns")
    ])


def plain_volumes(p: Pipeline) -> DataFrame:
    core = F.count(F.when(F.col("is_core"), F.lit(1))).over(Window.partitionBy("auid"))
    return (
        p.author_papers.withColumn("core", core)
        .filter(F.col("core") >= p.cfg.min_core_papers)
        .withColumn("mine", F.count(F.lit(1)).over(Window.partitionBy("auid", "subfield")))
        .withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("subfield")))
        .select("auid", "subfield", "mine", "all")
        .distinct()
    )


def grouped_volumes(p: Pipeline, save) -> DataFrame:
    counts = save("counts", subjects.subject_counts(p.author_papers, p.cfg))
    overall = counts.groupBy("subfield").agg(F.sum("n").alias("all"))
    mine = counts.groupBy("auid", "subfield").agg(F.sum("n").alias("mine"))
    return mine.join(overall, "subfield", "left")


def plain_thresholds(p: Pipeline) -> DataFrame:
    ranked = p.ranked.withColumn("top", ranking.is_top_listed(p.cfg))
    parts = []
    for subject in (F.col("subfield_1"), F.col("field_1"), F.lit("TOTAL")):
        rows = ranked.withColumn("subject", subject)
        cuts = []
        for prefix, (column, points, top_only) in thresholds.MEASURES.items():
            value = F.when(F.col("top"), F.col(column)) if top_only else F.col(column)
            rows = rows.withColumn(f"v_{prefix}", value)
            group = Window.partitionBy("subject")
            rows = rows.withColumn(f"n_{prefix}", F.count(f"v_{prefix}").over(group))
            rows = rows.withColumn(
                f"r_{prefix}", F.rank().over(group.orderBy(F.desc_nulls_last(f"v_{prefix}")))
            )
            left = F.col(f"n_{prefix}") - (F.col(f"r_{prefix}") - 1)
            for point in points:
                here = ratio(left, F.col(f"n_{prefix}")) >= point / 100
                cuts.append(F.min(F.when(here, F.col(f"v_{prefix}"))).alias(f"{prefix}_{point}"))
        parts.append(rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), *cuts))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def plain_ranks(authors):
    """Ranks by windows; the global ones order all authors in one task."""
    everyone, subfield = Window.partitionBy(F.lit(1)), Window.partitionBy("subfield_1")
    columns = []
    for b in ("ns", "ws"):
        best = F.col(f"{b}_c").desc_nulls_last()
        columns.append(F.rank().over(everyone.orderBy(best)).alias(f"{b}_rank"))
        columns.append(F.rank().over(subfield.orderBy(best)).alias(f"{b}_subfield_rank"))
    return authors.select("auid", *columns, F.count(F.lit(1)).over(subfield).alias("n"))


def comparisons(p: Pipeline):
    authors = ranking.eligible_authors(p.scored, p.cfg)
    spread = replace(p.cfg, hot_key_rows=max(16, authors.count() // 8))

    def save(name, df):
        path = f"{p.store.root}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").parquet(path)
        return p.spark.read.parquet(path)

    return {
        "distinct_citing: id arrays vs pairs": (
            lambda: plain_citing(p),
            lambda: profile.distinct_citing(p.author_papers, p.edges, p.cfg),
        ),
        "global_rank: one task vs spread": (
            lambda: plain_ranks(authors),
            lambda: ranking.score_ranks(authors, spread, save),
        ),
        "subject_volumes: windows vs group-bys": (
            lambda: plain_volumes(p),
            lambda: grouped_volumes(p, save),
        ),
        "thresholds: windows vs cells": (
            lambda: plain_thresholds(p),
            lambda: thresholds.subject_thresholds(p.ranked, p.cfg, save=save),
        ),
    }


def seconds(build) -> float:
    taken = []
    for _ in range(4):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken[1:])


def main(sf_dir: str) -> None:
    spark = bench.session()
    spark.sparkContext.setLogLevel("ERROR")
    scratch = f"{scratch_folder(spark)}/plain-{uuid.uuid4().hex[:12]}"
    inputs = tables.inputs(spark, sf_dir, f"{scratch}/inputs")
    p = Pipeline(spark, inputs, tables.CONFIG, f"{scratch}/stages", sf_dir)
    p.ranked.count()
    for name, (plain, ours) in comparisons(p).items():
        print(f"{name}: plain {seconds(plain):.2f}s, library {seconds(ours):.2f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else os.environ.get("BENCH_SF_DIR", bench.SF_DIR))
