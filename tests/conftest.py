import datetime as dt

import pytest
from pyspark.sql import SparkSession

from laurel import MetricConfig, schemas
from laurel.operators import authorship, citations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return MetricConfig(collections=("CORE", "MEDL"))


def author(auid, seq, given=None, surname=None, initials=None, pref=None, index=None):
    return (None if auid is None else str(auid), seq, given, surname, initials, pref, index)


def paper(eid, year=2000, kind="ar", coll="CORE", refs=(), authors=(), srcid=1, date=None,
          links=(), affiliations=()):
    """One publication row; ``authors`` are ids or full author tuples."""
    people = [
        a if isinstance(a, tuple) else author(a, i + 1) for i, a in enumerate(authors)
    ]
    return (
        eid, year, date or dt.date(year, 1, 1), kind, [coll], list(refs), (srcid,),
        people or None, list(links), list(affiliations),
    )


@pytest.fixture
def publications(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.PUBLICATIONS)


@pytest.fixture
def discontinued(spark):
    return lambda ids: spark.createDataFrame([(i,) for i in ids], schemas.DISCONTINUED)


@pytest.fixture
def no_classes(spark):
    return spark.createDataFrame([], "eid long, domain string, field string, subfield string")


@pytest.fixture
def author_rows(spark):
    """Author-on-paper rows from (auid, eid, cites, n_authors) and overrides."""

    def build(rows, **fixed):
        base = dict(
            year=2000, is_core=True, is_discontinued=0, discontinued_cites=0,
            subfield=None, field=None, author_seq=1,
        )
        records = []
        for auid, eid, cites, n in rows:
            records.append(
                {**base, **fixed, "auid": auid, "eid": eid, "ws_cites": cites,
                 "ns_cites": cites, "n_authors": n}
            )
        return spark.createDataFrame(
            records,
            "auid long, eid long, year int, is_core boolean, is_discontinued int, "
            "ws_cites long, ns_cites long, discontinued_cites long, subfield string, "
            "field string, n_authors int, author_seq int",
        )

    return build


def as_dict(df, key, *values):
    """Rows as {key: value} or {key: (values...)}."""
    out = {}
    for row in df.collect():
        picked = tuple(row[v] for v in values)
        out[row[key]] = picked[0] if len(values) == 1 else picked
    return out


def rows_of(pubs, discontinued, classification, cfg):
    edges = citations.citation_edges(pubs, discontinued, cfg)
    counts = citations.citation_counts(edges)
    return authorship.author_papers(pubs, counts, classification, discontinued, cfg), edges
