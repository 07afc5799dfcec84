"""Headline timings: one JSON line.

Each query starts from the written input tables and an empty stage store, so its
time covers every stage it needs. A small run first warms up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")

# name -> what is run to the end
QUERIES = {
    "citation_counts": lambda p: p.citation_counts,
    "h_index": lambda p: p.paper_metrics,
    "distinct_citing": lambda p: p.distinct_citing,
    "subject_ranking": lambda p: p.author_subjects,
    "author_names": lambda p: p.author_names,
    "author_institution": lambda p: p.author_institution,
    "composite_score": lambda p: p.scored,
    "global_rank": lambda p: p.ranked,
    "thresholds_total": lambda p: p.thresholds,
    "table1": lambda p: p.table1,
}


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def run(spark, sf_dir: str, names) -> dict[str, float]:
    from laurel_registry import tables
    from laurel.plans.pipeline import Pipeline
    from laurel_registry.scratch import scratch_folder

    scratch = f"{scratch_folder(spark)}/bench-{uuid.uuid4().hex[:12]}"
    inputs = tables.inputs(spark, sf_dir, f"{scratch}/inputs")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        p = Pipeline(spark, inputs, tables.CONFIG, f"{scratch}/{name}", version=sf_dir)
        QUERIES[name](p).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    wanted = sys.argv[1:] or list(QUERIES)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, WARM_DIR, wanted)
    seconds = run(spark, SF_DIR, wanted)
    print(json.dumps({
        "metric": "total seconds of the headline queries, each from the input tables",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
