from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from laurel import MetricConfig
from laurel.functions.ranks import positions
from laurel.plans import reports
from laurel.sources import readers
from laurel.sources.reports import (
    printed_report,
    read_report,
    text_schema,
    typed_report,
    write_report,
)
from laurel.sources.stages import StageStore
from laurel_registry.scratch import scratch_folder


def test_typed_and_printed_reports(spark):
    frame = spark.createDataFrame(
        [("12.34 %", "7", "1.5", "x"), (None, None, None, None), ("100.0%", "8.0", "bad", "y")],
        text_schema(["self%", "n", "c", "name"]),
    )
    kinds = {"self%": "perc", "n": "int", "c": "dec"}
    typed = typed_report(frame, kinds)
    assert [t for _, t in typed.dtypes] == ["double", "bigint", "double", "string"]
    assert [tuple(r) for r in typed.collect()] == [
        (0.1234, 7, 1.5, "x"), (None, None, None, None), (1.0, 8, None, "y"),
    ]
    assert tuple(printed_report(frame, kinds).collect()[1]) == ("N/A", "", "", None)
    with pytest.raises(ValueError):
        typed_report(frame, {"n": "money"})


def test_report_survives_quotes_and_keeps_its_order(spark, tmp_path):
    rows = [(i, 'a "quoted", name' if i % 2 else "plain") for i in range(200)]
    frame = spark.createDataFrame(rows, "i long, s string").repartition(8).orderBy("i")
    for single in (False, True):
        path = str(tmp_path / f"report-{single}")
        write_report(frame, path, single_file=single)
        back = read_report(spark, path, text_schema(["i", "s"]))
        assert sorted((int(r.i), r.s) for r in back.collect()) == rows
        files = sorted((tmp_path / f"report-{single}").glob("*.csv"))
        lines = [ln for f in files for ln in f.read_text().splitlines() if not ln.startswith("i,")]
        assert [int(ln.split(",")[0]) for ln in lines] == list(range(200))
        assert not single or len(files) == 1


def test_stage_store(spark, tmp_path, cfg):
    store = StageStore(spark, str(tmp_path), "v1")
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert store.get_or_build("s", cfg, lambda: build(5)).count() == 5
    assert store.get_or_build("s", cfg, lambda: build(6)).count() == 5
    assert built == [5]
    other = MetricConfig(collections=cfg.collections, rank_cutoff=7)
    assert store.get_or_build("s", other, lambda: build(7)).count() == 7
    assert StageStore(spark, str(tmp_path), "v2").get_or_build("s", cfg, lambda: build(8)).count() == 8


def test_unfinished_stage_is_rebuilt(spark, tmp_path, cfg):
    store = StageStore(spark, str(tmp_path))
    path = store.path("s", cfg)
    spark.range(3).write.parquet(path)
    import os

    os.remove(f"{path}/_SUCCESS")
    assert store.get_or_build("s", cfg, lambda: spark.range(4)).count() == 4


def test_scratch_folder_follows_the_session(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        scratch_folder(Session())


def test_label_resolution(spark):
    labels = spark.createDataFrame([("D", "F", "Soft Matter")], "domain string, field string, subfield string")
    raw = spark.createDataFrame([(1, "  soft MATTER "), (2, "other"), (3, None)],
                                "eid long, subfield_hybrid string")
    assert [tuple(r) for r in readers.resolve_labels(raw, labels).collect()] == [
        (1, "D", "F", "Soft Matter")
    ]


def test_readers_declare_their_schema(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(7,)], "srcid long").write.parquet(path)
    assert readers.read_discontinued(spark, path).collect()[0].srcid == 7
    assert readers.read_discontinued(spark, None).count() == 0
    assert readers.discontinued_from_ids(spark, [1, 2]).count() == 2
    assert readers.discontinued_from_ids(spark, None).count() == 0
    assert readers.dataset_path("s3a://b/", "v1", "full", "t") == "s3a://b/v1/full/t"


def test_dictionary_describes_every_published_column(spark):
    cfg = MetricConfig(collections=("X",), database_name="DB", scheme_name="S")
    rows = reports.table1_dictionary(spark, cfg).collect()
    assert len(rows) == 46
    by_field = {r.FIELD: (r.BASIS, r.DESCRIPTION) for r in rows}
    assert by_field["nc9620 (ns)"] == ("self-citations excluded", "total cites 1996-2020")
    assert by_field["np6020"] == ("", "# papers 1960-2020")
    assert by_field["np6020 cited9620"][0] == "all citations"
    assert "DB" in by_field["np6020_d"][1]
    assert "npsf" in by_field


def test_table2_puts_total_last(spark):
    from laurel.operators.thresholds import MEASURES

    cuts = [f"{p}_{pt}" for p, (_, pts, _) in MEASURES.items() for pt in pts]
    frame = spark.createDataFrame(
        [("subfield", "b", 10, 1, 2, 3), ("subfield", None, 4, 0, 0, None),
         ("total", "TOTAL", 14, 1, 2, 3)],
        "level string, subject string, n_authors long, n_top_rank_ns long, n_top_rank long, "
        "n_top_list long",
    ).withColumns({c: F.lit(0.5) for c in cuts})
    labels = spark.createDataFrame([("D", "F", "b")], "domain string, field string, subfield string")
    rows = reports.table2_subfield(frame, labels, MetricConfig(("X",))).collect()
    assert [r.Subfield for r in rows] == ["b", "Unassigned", "TOTAL"]
    assert rows[0]["% in 100k (ns)"] == "10.0%"
    assert rows[0]["top-list self%@95"] == "50.0 %"
    assert rows[1]["% in top-list"] is None
    assert len(rows[0]) == 28


def test_ratio_distribution_ignores_missing_ratios(spark, cfg):
    frame = spark.createDataFrame(
        [(1, "x", 1.0), (2, "x", 2.0), (3, "x", 2.0), (4, "x", 9.0), (5, "x", None), (6, "y", 1.0)],
        "author_id long, subfield_1 string, ws_cite_ratio double",
    ).withColumns({
        "ws_nc": F.lit(1), "ws_nc_citing": F.lit(1), "ns_rank": F.lit(10**9),
        "ws_rank": F.lit(10**9), "ns_subfield_rank": F.lit(9), "ws_subfield_rank": F.lit(9),
        "subfield_count": F.lit(9),
    })
    got = reports.ratio_distribution(frame, cfg, "x").collect()
    assert sorted((r.author_id, r.ratio_position) for r in got) == [(1, 0.25), (2, 0.5), (3, 0.5)]
    everywhere = reports.ratio_distribution(frame, replace(cfg, hot_key_rows=16)).collect()
    assert sorted((r.author_id, r.ratio_position) for r in everywhere) == [
        (1, 0.25), (2, 0.5), (3, 0.5), (6, 1.0)
    ]


def test_ratio_ranks_are_written_once_and_read(spark, cfg, tmp_path):
    """the ranks were worked out anew for the list of hot ratios and for the join."""
    frame = spark.range(200).select(
        F.col("id").alias("author_id"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("subfield_1"),
        (F.col("id") % 5 + 1).cast("double").alias("ws_cite_ratio"),
        *[F.lit(9).alias(c) for c in ("ws_nc", "ws_nc_citing", "ns_subfield_rank", "ws_subfield_rank", "subfield_count")],
        *[F.lit(10**9).alias(c) for c in ("ns_rank", "ws_rank")],
    )
    saved = []

    def save(name, df):
        saved.append(name)
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    small = replace(cfg, hot_key_rows=16)
    got = reports.ratio_distribution(frame, small, save=save)
    assert saved == ["ratio_ranks"]
    assert sorted(got.collect()) == sorted(reports.ratio_distribution(frame, small).collect())
    assert got.count() == 120  # ratios below 4


def test_labels_follow_the_cutoffs(spark):
    assert [reports.short_count(n) for n in (100_000, 2_000_000, 150, 0)] == ["100k", "2m", "150", "0"]


def test_positions_number_a_total_order_over_many_tasks(spark, tmp_path):
    def save(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    # a third of all rows share the first key; a column needs quoting
    rows = spark.range(0, 3000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("rank (ns)"), "id"
    )
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # or so few rows meet in one task
    spark.conf.set(merge, "false")
    try:
        placed = positions(rows, ["`rank (ns)`", F.col("id").desc()], save, "order").collect()
    finally:
        spark.conf.unset(merge)
    want = sorted(((r["rank (ns)"], -r["id"]) for r in rows.collect()))
    assert [(r["rank (ns)"], -r["id"]) for r in sorted(placed, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in placed) == list(range(1, 3001))
    parts = spark.read.parquet(f"{tmp_path}/order").select(F.shiftright("_at", 33)).distinct().count()
    assert parts > 1
    assert positions(rows.limit(0), ["id"], save, "none").collect() == []
