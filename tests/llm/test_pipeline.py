import corpus_pipeline
from laurel.llm import toxicity
from laurel.llm.tables import DOCUMENTS
from tests.llm.test_packing import check


def test_stages_and_final_rows(spark, plainly, tmp_path):
    """Every stage against a plain version on what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [tuple(r) for r in docs.collect()]
    stages = iter(corpus_pipeline.STAGES)

    def step(df):
        name, stage = next(stages)
        stage(spark, df, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert tuple(out.columns) == DOCUMENTS
        return out

    docs = step(docs)
    rows = [r for r in rows if model.score(r[1]) < 0.3]
    assert sorted(map(tuple, docs.collect())) == sorted(rows)
    docs = step(docs)
    first = {d for d, _, _, kept in plainly.near_groups(rows, 5) if kept}
    rows = [r for r in rows if r[0] in first]
    assert sorted(map(tuple, docs.collect())) == sorted(rows)
    docs = step(docs)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in plainly.leaks(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    assert sorted(map(tuple, docs.collect())) == sorted(rows)
    docs = step(docs)
    found = {r["doc_id"]: r for r in docs.collect()}
    assert set(found) == {r[0] for r in rows}
    for r in rows:
        if not plainly.base_spans(r[1]) and "[secret]" not in found[r[0]]["text"]:
            assert tuple(found[r[0]]) == r
        assert found[r[0]]["n_chars"] == len(found[r[0]]["text"])
    check(step(docs).collect(), [(d, r["text"]) for d, r in found.items()], 2048)


def test_odd_rows_pass_through(spark, odd, empty, tmp_path):
    sf = "/root/testdata/sf0.001"
    for k, df in enumerate((odd, empty)):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf).write.parquet(str(tmp_path / f"{k}-{name}"))
            df = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        rows = df.collect()
        assert bool(rows) == (k == 0)


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
