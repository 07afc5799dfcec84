"""The whole run on the driver's tables, against SQL and against itself."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laurel_registry import oracle, tables
from laurel_registry import queries as registered
from laurel_registry.compare import compare, connect
from laurel.plans import reports

from tests.conftest import SF


@pytest.fixture(scope="module")
def run(spark):
    return tables.pipeline(spark, SF)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_sql(spark, duck, name):
    problem = compare(spark, duck, SF, name, registered.queries()[name], oracle.oracle_sql()[name])
    assert problem == ""


def test_entry_is_the_top_list(spark):
    first = entry.entry(spark)
    assert first.columns[0] == "author_id" and first.count() > 0


def test_properties(run):
    r = run.ranked
    broken = r.filter(
        (F.col("ns_nc") > F.col("ws_nc"))
        | (F.col("ns_h") > F.col("ws_h"))
        | (F.col("ws_hm") > F.col("ws_h") + 1e-9)
        | (F.col("ws_h") > F.col("np"))
        | (F.col("ws_nps") > F.col("ws_npsf"))
        | (F.col("ws_npsf") > F.col("ws_npsfl"))
        | (F.col("ws_npsfl") > F.col("np"))
        | (F.col("ws_nc_citing") > F.col("ws_nc"))
        | ~F.col("ws_c").between(0, 6)
        | ~F.col("ns_c").between(0, 6)
    )
    assert broken.count() == 0
    t = run.thresholds
    assert t.filter(
        (F.col("cites_25") > F.col("cites_50")) | (F.col("cites_50") > F.col("cites_75"))
        | (F.col("cites_75") > F.col("cites_99")) | (F.col("c_90") > F.col("c_99"))
    ).count() == 0
    totals = {x.level: x.n for x in t.groupBy("level").agg(F.sum("n_authors").alias("n")).collect()}
    assert totals["subfield"] == totals["field"] == totals["total"] == r.count()
    top = reports.table1_rows(r, run.cfg)
    kept = r.filter((F.col("ns_rank") <= run.cfg.rank_cutoff) | (F.col("ws_rank") <= run.cfg.rank_cutoff))
    assert kept.join(top, "author_id", "left_anti").count() == 0


def _no_batches(df):
    return sorted(map(repr, df.orderBy("author_id").collect()))


def test_spreading_and_layout_do_not_change_results(spark, run, tmp_path):
    small = replace(run.cfg, hot_key_rows=40)
    pubs = run.inputs.publications.repartition(3, "year")
    moved = replace(run.inputs, publications=pubs)
    other = type(run)(spark, moved, small, str(tmp_path), "moved")
    assert not other.hot_cited.isEmpty() and other.hot_authors.isEmpty()
    assert _no_batches(other.ranked) == _no_batches(run.ranked)
    tiny = type(run)(spark, run.inputs, replace(run.cfg, hot_key_rows=25), str(tmp_path), "tiny")
    assert not tiny.hot_authors.isEmpty()
    assert _no_batches(tiny.ranked) == _no_batches(run.ranked)
    order = ["level", "subject"]
    assert sorted(map(repr, tiny.thresholds.orderBy(order).collect())) == sorted(
        map(repr, run.thresholds.orderBy(order).collect())
    )


def test_inputs_are_unique_and_reports_are_written(run, tmp_path):
    run.check_inputs()
    written = run.write_reports(str(tmp_path))
    assert len(written) == 5
    key = run.spark.read.option("header", "true").csv(written["Table_1_Key"])
    assert key.count() == 46


def test_changed_discontinued_list_changes_the_stage_key(spark, run, tmp_path):
    same = type(run)(spark, run.inputs, run.cfg, str(tmp_path), "v")
    longer = replace(run.inputs, discontinued=spark.range(9).select(F.col("id").alias("srcid")))
    other = type(run)(spark, longer, run.cfg, str(tmp_path), "v")
    assert same.store.path("edges", run.cfg) != other.store.path("edges", run.cfg)


def test_changed_publications_change_the_stage_key(spark, run, tmp_path):
    run.inputs.publications.write.parquet(str(tmp_path / "a"))
    run.inputs.publications.limit(5).write.parquet(str(tmp_path / "b"))
    keys = {
        type(run)(
            spark, replace(run.inputs, publications=spark.read.parquet(str(tmp_path / p))), run.cfg, "r", "v"
        ).store.path("edges", run.cfg)
        for p in ("a", "b")
    }
    assert len(keys) == 2
    with pytest.raises(ValueError):
        type(run)(spark, run.inputs, run.cfg, "r", "")


def test_a_third_of_the_authors_is_dropped_before_the_heavy_work(run):
    profiled = run.core_papers.select("auid").distinct().count()
    assert profiled <= 2 / 3 * run.author_papers.select("auid").distinct().count()
    assert run.distinct_citing.join(run.core_papers, "auid", "left_anti").count() == 0
