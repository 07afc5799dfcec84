import os
import random
import uuid

import duckdb
import pytest

from laurel.llm import line_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def made(seed):
    r = random.Random(seed)
    lines = ["", " ", "short", "É" * 19, "É" * 20, "Ä" + "x" * 19, "ä" + "x" * 19] + [f"A line that is Long enough, number {i}" for i in range(30)]
    rows = []
    for i in range(120):
        text = "\n".join(r.choice(["", "\t", " \r", " "]) + r.choice([str, str.upper])(r.choice(lines)) + r.choice(["", " "]) for _ in range(r.randint(0, 9)))
        rows.append((r.choice([i, i, 3, None]), text, "en", "s", 0))
    return rows + [(5, "x" * 25 + "\n" + ("y" * 30 + "\n") * 4_000, "en", "s", 0), (6, "Y" * 30, "en", "s", 0), (None, None, None, None, None)] + rows[:3] * 5


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"batches": 1}), (3, {"batches": 7, "fanout": 2}), (4, {"least_docs": 2, "least_chars": 5})])
def test_against_the_definition(spark, plainly, seed, options):
    rows = made(seed)
    found = line_dedup.remove_lines(spark.createDataFrame(rows, SCHEMA), **options)
    expected = plainly.line_repeats(rows, options.get("least_chars", 20), options.get("least_docs", 3))
    assert rows_of(found) == sorted(expected, key=str)


def test_odd_rows(odd, odd_rows, plainly):
    assert rows_of(line_dedup.remove_lines(odd)) == sorted(plainly.line_repeats(odd_rows), key=str)


def test_kept_text_comes_along(spark):
    rows = [(i, f"{'same line ' * 3}\nown {i}", "en", "s", 0) for i in range(4)]
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.remove_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {0: "own 0", 1: "own 1", 2: "own 2", 3: rows[3][1]}


def test_sql_agrees(spark):
    from laurel.llm.queries import op13_line_dedup

    con = duckdb.connect()
    path = f"{SF}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    expected = con.execute(f"SELECT {', '.join(NAMES)} FROM ({line_dedup.oracle()})").fetchall()
    assert rows_of(op13_line_dedup(spark, SF)) == sorted(expected, key=str)


def test_empty_table(empty):
    assert line_dedup.remove_lines(empty).collect() == []


def test_runs_merge_without_a_shuffle_and_settled_keys_are_not_added(spark, tmp_path):
    runs = line_dedup.Runs(spark, f"{tmp_path}/{uuid.uuid4().hex}", 4, 2)
    for k in range(5):
        rows = spark.range(100).selectExpr("id as h", "-id as g", "1 + id % 2 as n", f"{10 - k} as last", "1L as lines")
        runs.add(rows, 3)
    assert runs.levels == [[runs.levels[0][0]], [], [runs.levels[2][0]]]
    found = {r["h"]: (r["n"], r["last"]) for r in runs.merged().collect()}
    assert found == {h: (3, 10) if h % 2 == 0 else (4, 10) for h in range(100)}  # n stops once a key is settled
    plan = runs.new_to(0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name == runs.name]


def test_everything_stays_in_the_jvm(small):
    plan = line_dedup.remove_lines(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
