"""What the plans must and must not contain."""

import contextlib
import io
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from laurel_registry import queries as registered
from laurel_registry import tables
from laurel.functions.bloom import id_filter
from laurel.operators import authorship, citations, institutions, names, profile, ranking, thresholds
from laurel.plans.pipeline import LAYOUTS
from laurel.plans.run import load_inputs, run
from laurel.sources import readers
from laurel.sources.stages import StageStore

from tests.conftest import SF, paper


def text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def pipe(spark):
    return tables.pipeline(spark, SF)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_no_pairwise_joins_and_no_python_in_any_plan(spark, name):
    plan = text(registered.queries()[name](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval"):
        assert banned not in plan


def read_schemas(plan):
    return [s for s in re.findall(r"ReadSchema: (.*)", plan) if "Au:" in s]


def test_scans_leave_names_on_disk(pipe):
    pubs, cfg = pipe.inputs.publications, pipe.cfg
    edges = text(citations.citation_edges(pubs, pipe.inputs.discontinued, cfg))
    rows = text(authorship.author_papers(
        pubs, pipe.citation_counts, pipe.inputs.classification, pipe.inputs.discontinued, cfg
    ))
    links = text(institutions.author_affiliations(pubs, cfg))
    for plan in (edges, rows, links):
        assert read_schemas(plan)
        for schema in read_schemas(plan):
            assert "surname_pn" not in schema and "given_name_pn" not in schema
    assert "Au" not in re.findall(
        r"ReadSchema: (.*)", text(citations.reference_counts(pubs, cfg))
    )[0]


def records_written(df, partitioning):
    """Rows that a query which has run sent through the exchanges with this partitioning."""
    found, queue = {}, [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            queue.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            queue.append(node.plan())
        elif node.nodeName() == "Exchange" and partitioning in node.toString().split("\n")[0]:
            found[node.id()] = node.metrics().apply("shuffleRecordsWritten").value()
        queue += [node.children().apply(i) for i in range(node.children().size())]
    assert found
    return sum(found.values())


def exchanged(plan):
    return re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)


def test_author_lists_travel_for_pairs_whose_signatures_meet_only(pipe):
    pubs, cfg = pipe.inputs.publications, pipe.cfg
    pairs = text(citations.edge_candidates(
        pubs, pipe.inputs.discontinued, cfg, pipe.hot_cited, pipe.known_papers
    ))
    assert exchanged(pairs) and not [x for x in exchanged(pairs) if "auid" in x]
    reading = text(pipe.edges)
    assert "edges-" in reading  # written once, read from there on
    whole = text(citations.citation_edges(
        pubs, pipe.inputs.discontinued, cfg, pipe.hot_cited, pipe.known_papers, pipe.save
    ))
    assert "edge_candidates-" in whole
    for travels in exchanged(whole):  # ids of pairs, or the list of one paper
        assert "auid" not in travels or "maybe_self" not in travels


def test_unknown_references_stay_out_of_the_exchange(pipe, publications, discontinued):
    rows = [paper(i, refs=[i - 1, *range(10_000 + 20 * i, 10_020 + 20 * i)]) for i in range(50)]
    pubs, cfg = publications(rows), pipe.cfg

    def sent(known):
        config = pubs.sparkSession.conf
        config.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            pairs = citations.edge_candidates(pubs, discontinued([]), cfg, None, known)
            assert len(pairs.collect()) == 49
            return records_written(pairs, "hashpartitioning(cited_eid")
        finally:
            config.unset("spark.sql.autoBroadcastJoinThreshold")

    assert sent(None) == 50 * 21 + 50
    assert sent(citations.known_papers(pubs)) <= 49 + 1 + 50 + 0.05 * 50 * 20


def test_very_cited_papers_are_found_by_a_sketch(pipe):
    plan = text(citations.heavy_references(pipe.inputs.publications, pipe.cfg))
    first = exchanged(plan)
    assert any(x.startswith("[2]") or "_cell" in x for x in first)


def test_year_filters_reach_the_scan(pipe):
    pubs, cfg = pipe.inputs.publications, pipe.cfg
    assert "GreaterThanOrEqual(year,1997)" in text(citations.reference_counts(pubs, cfg))
    assert "LessThanOrEqual(year,2000)" in text(authorship.counted_publications(pubs, cfg))


def scanned_files(df):
    """Files that the scans of a query which has run have read."""
    found, queue = 0, [df._jdf.queryExecution().executedPlan()]
    while queue:
        node = queue.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            queue.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            queue.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numFiles").value()
        queue += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_only_the_years_asked_for_are_read(spark, pipe, tmp_path):
    pubs, cfg = pipe.inputs.publications, replace(pipe.cfg, min_cite_year=2000)
    years = {r.year: r["count"] for r in pubs.groupBy("year").count().collect()}
    readers.write_publications(pubs, str(tmp_path / "pubs"), rows_per_file=100)
    divided = readers.read_publications(spark, str(tmp_path / "pubs"))
    assert sorted(divided.schema.names) == sorted(pubs.schema.names)
    assert divided.select(pubs.columns).exceptAll(pubs).count() == 0 == pubs.exceptAll(divided.select(pubs.columns)).count()
    papers = citations.citing_papers(divided, cfg).select("eid")
    papers.collect()
    assert re.search(r"PartitionFilters: \[[^]]*year[^]]*>= 2000", text(papers))
    folders = [f for f in divided.inputFiles() if int(re.search(r"year=(\d+)", f)[1]) >= 2000]
    assert 0 < scanned_files(papers) == len(folders) < len(divided.inputFiles())
    for year, n in years.items():  # a large year is dealt over several files, none has one per task
        files = [f for f in divided.inputFiles() if f"year={year}/" in f]
        assert 1 <= len(files) <= -(-n // 100)


def test_papers_without_a_year_stay(spark, publications, tmp_path):
    rows = [paper(i, 2000 + i % 2) for i in range(40)]
    pubs = publications(rows).withColumn("year", F.when(F.col("eid") % 3 > 0, F.col("year")))
    readers.write_publications(pubs, str(tmp_path / "pubs"), rows_per_file=5)
    back = readers.read_publications(spark, str(tmp_path / "pubs"))
    key = lambda df: sorted(((r.eid, r.year) for r in df.select("eid", "year").collect()), key=str)
    assert key(back) == key(pubs)
    readers.write_publications(publications([]), str(tmp_path / "none"))
    assert readers.read_publications(spark, str(tmp_path / "none")).count() == 0


def test_links_of_papers_in_order_are_not_shuffled(spark, publications, pipe):
    rows = [paper(i, authors=[10, 11], links=[(1, 1), (2, 1)], affiliations=[(5, ["A"], "X")]) for i in range(30)]
    people = [(str(a), 2, None, None, None, None, None) for a in (10, 11)]
    rows += [paper(i, authors=people, links=[(2, 1)], affiliations=[(5, ["A"], "X")]) for i in range(30, 33)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = institutions.author_affiliations(publications(rows), pipe.cfg)
        assert len(links.collect()) == 60 + 6
        assert records_written(links, "hashpartitioning(eid") == 3 + 6  # links and slots of the last three
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_windows_and_sums_share_one_shuffle_by_author(pipe):
    rows = pipe.spark.read.parquet(*{f.rsplit("/", 1)[0] for f in pipe.core_papers.inputFiles()})
    plan = text(profile.paper_metrics(rows, pipe.cfg))
    assert len(re.findall(r"hashpartitioning\(auid", plan)) == 1


def test_stages_are_read_without_an_exchange_on_their_key(pipe):
    assert "hashpartitioning" not in text(pipe.citation_counts)
    assert "hashpartitioning" not in text(profile.paper_metrics(pipe.core_papers, pipe.cfg))
    assert "hashpartitioning" not in text(authorship.author_sizes(pipe.author_papers))
    assert "auid" not in "".join(re.findall(r"hashpartitioning\(.*", text(
        authorship.rows_of_core_authors(pipe.author_papers, authorship.author_sizes(pipe.author_papers), pipe.cfg))))
    joined = text(authorship.author_papers(
        pipe.inputs.publications, pipe.citation_counts, pipe.inputs.classification, pipe.inputs.discontinued, pipe.cfg))
    assert "cited_eid" not in "".join(re.findall(r"hashpartitioning\(.*", joined))


def test_a_run_that_resumes_names_its_buckets_again(spark, pipe):
    path = pipe.store.path("edges", pipe.cfg, LAYOUTS["edges"])
    before = sorted(pipe.edges.collect())
    for table in spark.catalog.listTables():
        if table.name.startswith("laurel_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = pipe.store.get_or_build("edges", pipe.cfg, lambda: None, LAYOUTS["edges"])
    assert path in again.inputFiles()[0]
    assert sorted(again.collect()) == before
    assert "hashpartitioning" not in text(citations.citation_counts(again))


def test_cutoffs_read_the_authors_once_and_merge_histograms(pipe):
    assert pipe.thresholds is not None
    values = pipe.save("threshold_values", None)  # the thresholds stage has written it
    assert {"subfield_1", "field_1", "measure", "value", "n_authors"} == set(values.columns)
    cells = text(thresholds.cutoff_cells(thresholds.subject_cells(values)))
    # the three levels are listed after the first aggregation, from counts
    tree = cells[: cells.index("(1)")]  # printed from the last step to the first
    assert tree.index("Generate") < tree.rindex("HashAggregate")
    assert "ranked-" not in text(thresholds.percentile_cutoffs(values))
    by_level = {r.level: r.n for r in thresholds.subject_cells(values).filter("measure = 'c'")
                .groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert set(by_level.values()) == {pipe.ranked.filter("ws_c is not null").count()}


def test_no_window_orders_everything_in_one_task(pipe):
    for name in ("global_rank", "subfield_rank", "h_index", "distinct_citing", "thresholds_total", "ratio_distribution"):
        plan = text(registered.PLANS[name](pipe))
        for window in re.findall(r"Window \(\d+\)[^\n]*\n[^\n]*\n", plan):
            assert "SinglePartition" not in window
        assert "windowspecdefinition(1," not in plan


def test_citing_and_positions_read_profiled_authors_only(pipe):
    for frame in (pipe.distinct_citing, pipe.paper_metrics):
        assert "core_papers" in text(frame)


def test_run_from_paths(spark, pipe, tmp_path):
    folder = str(tmp_path)
    pipe.inputs.publications.withColumnRenamed("eid", "Eid").write.parquet(f"{folder}/pubs")
    pipe.inputs.institutions.write.parquet(f"{folder}/inst")
    tables.paper_subfields(spark, SF).write.parquet(f"{folder}/classes")
    pipe.inputs.labels.write.parquet(f"{folder}/labels")
    inputs = load_inputs(
        spark, f"{folder}/pubs", f"{folder}/inst", f"{folder}/classes", f"{folder}/labels", range(7)
    )
    written = run(spark, inputs, pipe.cfg, f"{folder}/stages", f"{folder}/out", "v1")
    table = spark.read.option("header", "true").csv(written["Table_1_Authors"])
    assert table.count() == pipe.table1.count()
    again = run(spark, inputs, pipe.cfg, f"{folder}/stages", f"{folder}/out", "v1")
    assert again == written


@pytest.fixture
def unbroadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_travel_to_their_paper_once(spark, tmp_path, unbroadcast):
    day = "timestamp'1998-02-03'"
    made = {
        "nation": "SELECT 1 n_nationkey, 'PERU' n_name",
        "supplier": "SELECT * FROM VALUES (10L, 'S10', 1), (9L, 'S9', 1), (11L, 'S11', 2) t(s_suppkey, s_name, s_nationkey)",
        # part 4 twice, with two names; part 6 is not there
        "part": "SELECT * FROM VALUES (4L, 'bolt', 1), (4L, 'axle', 1), (11L, 'nut', 11), (null, 'none', 1) t(p_partkey, p_name, p_size)",
        "orders": f"SELECT * FROM VALUES (3L, {day}, '2-HIGH'), (5L, {day}, '1-URGENT'), (null, {day}, null) t(o_orderkey, o_orderdate, o_orderpriority)",
        "lineitem": "SELECT * FROM VALUES (3L, 11L, 10L, 2), (3L, 4L, 9L, 3), (3L, 4L, 10L, 1), (3L, 4L, 10L, null), (3L, 6L, 11L, 1), "
        "(3L, null, null, 5), (7L, 4L, 9L, 1), (null, 4L, 9L, 1) t(l_orderkey, l_partkey, l_suppkey, l_linenumber)",
    }
    for name, sql in made.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    papers = tables.publications(spark, str(tmp_path))
    got = {row["eid"]: row for row in papers.collect()}
    assert set(got) == {3, 5, None} and got[5]["Au"] is None and got[5]["Af"] is None
    assert [(a["Authorseq"], a["auid"], a["surname_pn"], a["indexed_name"]) for a in got[3]["Au"]] == [
        (1, "4", "axle", "axle X"), (2, "4", "bolt", "bolt X"), (3, str(12 * tables.SPLIT + 3), None, "nut X"),
    ]
    assert [(a["afid"], a["affiliation_organization"]) for a in got[3]["Af"]] == [(9, []), (10, ["Dept 0", "S10"])]
    assert [tuple(x) for x in got[3]["Au_af"]] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]
    # part 4 counts twice for its four lines with a paper; three orders
    assert records_written(papers, "hashpartitioning(eid") == 7 + 4 + 3


def test_author_lists_of_other_papers_stay_out_of_the_exchange(
    spark, pipe, publications, discontinued, tmp_path, unbroadcast
):
    # only paper 1 shares an author with a paper it cites
    rows = [paper(i, refs=[i - 1], authors=[1000 + max(i, 1)]) for i in range(400)]
    store = StageStore(spark, str(tmp_path), "meeting")
    save = lambda name, df: store.get_or_build(name, pipe.cfg, lambda: df)
    edges = citations.citation_edges(publications(rows), discontinued([]), pipe.cfg, save=save)
    assert {(r["citing_eid"], r["is_self"]) for r in edges.collect() if r["is_self"]} == {(1, 1)}
    met = store.get_or_build("edge_candidates", pipe.cfg, None).filter("maybe_self = 1").count()
    assert met < 50
    assert records_written(edges, "hashpartitioning(cited_eid") <= met + 2 * met + 0.05 * 400
    assert records_written(edges, "hashpartitioning(citing_eid") <= met + 2 * met + 0.05 * 400


def test_names_and_institutions_of_ranked_authors_only(spark, pipe, publications):
    wanted = id_filter(spark.range(1000, 1010).toDF("auid"), "auid")
    pubs = publications([
        paper(i, authors=[1000 + i], links=[(1, 1)], affiliations=[(7, ["X"], "PERU")]) for i in range(400)
    ])
    links = institutions.author_affiliations(pubs, pipe.cfg)
    for few, all_ in (
        (names.author_names(pubs, pipe.cfg, wanted), names.author_names(pubs, pipe.cfg)),
        (institutions.dominant_affiliation(links, wanted), institutions.dominant_affiliation(links)),
    ):
        mine = F.col("auid") < 1010
        assert sorted(map(str, few.filter(mine).collect())) == sorted(map(str, all_.filter(mine).collect()))
        few.collect()
        assert records_written(few, "hashpartitioning(auid") <= 2 * (10 + 0.05 * 400)
    assert pipe.ranked.count() > 0
    assert pipe.store.is_complete(pipe.store.path("profiled_authors", pipe.cfg))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_papers_and_edges_are_joined_in_their_buckets(pipe, no_broadcast):
    """Author lists and edges were exchanged again for every join by paper."""
    inputs = pipe.inputs
    rows = text(authorship.author_papers(
        inputs.publications, pipe.citation_counts, inputs.classification, inputs.discontinued, pipe.cfg
    ).drop("is_discontinued"))
    by_source = [x for x in exchanged(rows) if "_srcid" in x]
    assert not [x for x in exchanged(rows) if "slots" in x and x not in by_source]
    pairs = text(pipe.distinct_citing)
    assert exchanged(pairs) and not [x for x in exchanged(pairs) if "cited_eid" in x]


def test_subjects_of_an_author_are_not_exchanged(pipe):
    """Subject lists travelled by author twice, the profile with its arrays once."""
    assert not [x for x in exchanged(text(pipe.author_subjects)) if "auid" in x]
    ranked = text(ranking.rank_authors(
        pipe.scored, pipe.author_names, pipe.author_institution, pipe.cfg, pipe.save
    ))
    assert exchanged(ranked) and not [x for x in exchanged(ranked) if "subfields" in x]


def test_a_short_list_of_suppliers_does_not_shuffle_the_lines(spark, tmp_path):
    """The size of a join is guessed, that of written homes is known."""
    homes = tables.homes(spark, SF)
    homes.write.parquet(str(tmp_path / "homes"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plan = text(tables.publications(spark, SF, spark.read.parquet(str(tmp_path / "homes"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_suppkey" not in plan and "hashpartitioning(afid" not in plan
    assert not [x for x in exchanged(plan) if "s_name" in x and "p_name" in x]
    # papers are not dealt over fewer partitions than asked for, which would spill
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


def test_publications_are_not_rebuilt_for_nullability(spark):
    """casts that changed no type rebuilt every author list."""
    plan = tables.publications(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "as array<struct" not in plan


def test_author_records_are_made_once(spark):
    """each was made for sorting and copied field by field into its list."""
    plan = tables.publications(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "indexed_name_pn" in plan and "person" not in plan


def test_stages_are_packed(pipe):
    """Stages were written with the default codec, a third larger."""
    for stage in (pipe.inputs.publications, pipe.edges, pipe.core_papers, pipe.ranked):
        assert all(f.endswith(".zstd.parquet") for f in stage.inputFiles())


def test_papers_that_cannot_be_hot_are_not_counted(spark, pipe):
    """All papers of profiled authors travelled to find those with too many pairs."""
    rows = spark.createDataFrame(
        [(10 + j, i, 1995, 2, 2) for i in range(100) for j in range(2)] + [(10, 500, 1995, 40, 1)],
        "auid long, eid long, year int, ws_cites long, n_authors int",
    )
    edges = spark.createDataFrame(
        [(i, 1000 + k, 0) for i in range(100) for k in range(2)] + [(500, 1000 + k, 0) for k in range(40)],
        "cited_eid long, citing_eid long, is_self int",
    )
    kept = {}
    save = lambda name, df: kept.setdefault(name, df)
    found = profile.distinct_citing(rows, edges, replace(pipe.cfg, hot_key_rows=30), save)
    assert {r.auid: r.ws_nc_citing for r in found.collect()} == {10: 40, 11: 2}
    assert [(r.eid, r._slices) for r in kept["hot_pairs"].collect()] == [(500, 2)]
    assert records_written(kept["hot_pairs"], "hashpartitioning(eid") == 1


def test_tasks_follow_the_lines_and_not_the_session_alone(spark, tmp_path, monkeypatch):
    """With few shuffle partitions a task gathered millions of lines and spilled."""
    few = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(tables, "TASK_LINES", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    p = tables.pipeline(spark, SF, root=str(tmp_path))
    assert p.store.buckets == -(-lines // 500) > int(few)
    for stage in (p.inputs.publications, p.edges, p.core_papers, p.author_profile):
        assert int(few) < len(stage.inputFiles()) <= p.store.buckets
    # a task of each stage that gathers reads its share
    gathered = p.inputs.publications.groupBy(F.input_file_name()).agg(F.sum(F.size("Au")).alias("n"))
    assert gathered.agg(F.max("n")).first()[0] < 3 * 500
    # buckets are still read without an exchange, pairs go to as many tasks, the session keeps its setting
    assert "hashpartitioning" not in text(p.paper_metrics)
    pairs = re.findall(r"hashpartitioning\(auid#\w+, citing_eid#\w+, (\d+)\), (\w+)", text(p.distinct_citing))
    assert pairs == [(str(p.store.buckets), "REPARTITION_BY_NUM")]
    assert spark.conf.get("spark.sql.shuffle.partitions") == few
    usual = tables.pipeline(spark, SF).table2_subfield.collect()
    assert p.table2_subfield.collect() == usual


def test_a_stage_that_fails_leaves_the_setting_of_the_session(spark, tmp_path, pipe):
    """the number of shuffle partitions is raised for the stage alone."""
    few = spark.conf.get("spark.sql.shuffle.partitions")
    store = StageStore(spark, str(tmp_path), "failing", 9)

    def build():
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        raise RuntimeError("no rows")

    with pytest.raises(RuntimeError):
        store.get_or_build("s", pipe.cfg, build)
    assert store.buckets == 9 and spark.conf.get("spark.sql.shuffle.partitions") == few


def test_links_of_earlier_years_stay_out_of_the_exchange(spark, pipe, publications):
    """Every link of a profiled author travelled with its names, the last year decides."""
    pubs = publications([
        paper(i, year=1990 + i % 8, authors=[1000 + i // 8], links=[(1, 1)],
              affiliations=[(7 + i % 3, ["X"], "PERU")])
        for i in range(400)
    ])
    links = institutions.author_affiliations(pubs, pipe.cfg)
    years = institutions.last_affiliated_years(links)
    assert {(r.auid, r.year) for r in years.collect()} == {(1000 + i, 1997) for i in range(50)}
    few = institutions.dominant_affiliation(links, None, id_filter(years, "_key"))
    assert sorted(few.collect()) == sorted(institutions.dominant_affiliation(links).collect())
    few.collect()
    assert records_written(few, "hashpartitioning(auid") <= 2 * (50 + 0.05 * 400)
    assert pipe.ranked.count() > 0
    assert pipe.store.is_complete(pipe.store.path("profiled_last_years", pipe.cfg))


def test_links_without_a_year_decide_if_there_are_no_others(spark, pipe, publications):
    pubs = publications([
        paper(i, authors=[1000 + i // 2], links=[(1, 1)], affiliations=[(i, ["X"], "PERU")]) for i in range(40)
    ]).withColumn("year", F.when(F.col("eid") % 4 == 3, 1990))
    links = institutions.author_affiliations(pubs, pipe.cfg)
    last = id_filter(institutions.last_affiliated_years(links), "_key")
    few = institutions.dominant_affiliation(links, None, last).collect()
    assert sorted(few) == sorted(institutions.dominant_affiliation(links).collect())
    assert {r.auid: r.affil_id for r in few}[1001] == 3 and len(few) == 20
