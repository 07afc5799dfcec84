"""The driver's order tables read as a bibliographic database.

orders -> papers, lineitem -> author slots and affiliation links, part -> author
names, supplier -> institutions, nation and region -> subfields and fields.
Every rule is row-local or keyed by paper, so the mapping is linear in its input.
References are arithmetic in the paper id: a decreasing ladder (id/10, id/100,
id/1000) gives a long tail of well-cited papers, ``id % 50`` fifty very cited
ones, the differences some negative ids that no paper has, one pair a repeat.
"""

from __future__ import annotations

import math
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laurel import schemas
from laurel.config import MetricConfig
from laurel.plans.pipeline import Inputs, Pipeline
from laurel.sources import readers
from laurel.sources.stages import Layout, StageStore
from laurel_registry.scratch import scratch_folder

CONFIG = MetricConfig(
    collections=("CORE", "MEDL"),
    min_year=1995,
    min_cite_year=1997,
    max_year=2000,
    rank_cutoff=100,
    subfield_fraction=0.05,
    stamp="20010801",
)

# the same run with so low a limit that hot papers, authors, scores and institutions occur
HOT_CONFIG = replace(CONFIG, hot_key_rows=25)
# citations of the last year alone
SINGLE_YEAR_CONFIG = replace(CONFIG, min_cite_year=2000)
# citations until the year before the last
MAX_CITE_CONFIG = replace(CONFIG, max_cite_year=1999)
# placeholder authors make self-citations too
STRICT_CONFIG = replace(CONFIG, strict_reference=True)
PREPRINT_CONFIG = replace(CONFIG, include_preprints=True)

# same run with a lower year bound and preprints counted
LOWER_YEAR_CONFIG = MetricConfig(
    collections=("CORE", "MEDL"),
    min_year=1995,
    min_cite_year=1997,
    max_year=2000,
    overall_min_year=1996,
    include_preprints=True,
    rank_cutoff=100,
    subfield_fraction=0.05,
    stamp="20010801",
)


# joins by paper read the publications in their buckets
PUBLICATION_LAYOUT = Layout(bucket_by="eid")

# Lines that one task gathers to papers, as records of a few hundred bytes that are sorted several times.
TASK_LINES = 200_000

# ids of the authors that one part stands for: part key plus one, times this, plus a number below 40
SPLIT = 10_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _references(eid):
    def when(condition, value):
        return F.when(condition, value)

    candidates = [
        F.floor(eid / 10),
        F.floor(eid / 100),
        F.floor(eid / 1000),
        eid % 50,
        eid - 7,
        when(eid % 6 >= 2, eid - 14),
        when(eid % 6 >= 3, eid - 21),
        when(eid % 6 >= 4, eid - 35),
        when(eid % 6 >= 4, eid - 35),
    ]
    return F.array(*[F.nullif(c.cast("long"), eid) for c in candidates])


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows that have a key, with ``<key>_copy`` telling those of one key apart."""
    copies = Window.partitionBy(key).orderBy(*order)
    return df.filter(F.col(key).isNotNull()).withColumn(f"{key}_copy", F.row_number().over(copies))


def _starts(rows, *fields: str):
    """Places, from 0, at which a sorted array of structs turns to other values of ``fields``."""

    def turns(i):
        here, before = F.get(rows, i), F.get(rows, i - 1)
        out = i == 0
        for f in fields:
            out = out | (here[f] != before[f])
        return out

    places = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1))
    return F.coalesce(F.filter(places, turns), F.array().cast("array<int>"))


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the lines call for; the count reads no column."""
    return math.ceil(_table(spark, sf_dir, "lineitem").count() / TASK_LINES)


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the names of their nations, those of one key numbered."""
    supplier = _table(spark, sf_dir, "supplier")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    found = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("afid"), "s_name", "n_name"
    )
    return _numbered(found, "afid", "s_name", "n_name")


def publications(
    spark: SparkSession, sf_dir: str, suppliers: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Nested publication records. A paper's own lists are the only groups gathered.

    Lines take the names of their part and supplier as flat rows, travel to their paper once and
    are gathered there once; both lists are then made from the sorted lines, in linear time. ``suppliers``
    (``homes``, written) have a known size: Spark need not shuffle the lines to meet a short list,
    and its names are added where the lines of a paper are. The lines go to as many ``tasks``, by
    default the shuffle partitions.
    """
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_name", "p_size")
    lines = (
        _table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("eid"),
            F.col("l_partkey").alias("partkey"),
            F.col("l_suppkey").alias("afid"),
            F.col("l_linenumber").alias("line"),
        )
        .filter(F.col("eid").isNotNull())
        .join(_numbered(part, "partkey", "p_name", "p_size"), "partkey", "left")
    )
    # as many partitions as asked for: joined ones would hold more lines than fit in memory
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if suppliers is None:
        lines = lines.join(homes(spark, sf_dir), "afid", "left").repartition(n, "eid")
    else:
        lines = lines.repartition(n, "eid").join(suppliers, "afid", "left")
    by_paper = lines.groupBy("eid").agg(
        F.collect_list(
            F.struct(
                "partkey", "partkey_copy", "line", "afid", "afid_copy", "p_name", "p_size", "s_name", "n_name"
            )
        ).alias("lines")
    )
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("eid"), "o_orderdate", "o_orderpriority"
    )
    # lines of one part, and of one supplier, side by side
    by_part = F.sort_array(F.filter("lines", lambda x: x["partkey_copy"].isNotNull()))
    by_home = F.sort_array(
        F.transform(
            F.filter("lines", lambda x: x["afid_copy"].isNotNull()),
            lambda x: F.struct(*[x[n].alias(n) for n in ("afid", "afid_copy", "s_name", "n_name")]),
        )
    )
    papers = orders.join(by_paper, "eid", "left").select(
        "*", by_part.alias("by_part"), by_home.alias("by_home")
    )
    papers = papers.select(
        "eid", "o_orderdate", "o_orderpriority", "by_part", "by_home",
        _starts(F.col("by_part"), "partkey", "partkey_copy").alias("parts"),
        _starts(F.col("by_home"), "afid", "afid_copy").alias("homes"),
    )
    # two of five parts stand for many authors each, none with enough papers to be profiled
    auid = lambda partkey: F.when(
        partkey % 5 < 2, (partkey + 1) * SPLIT + F.col("eid") % 40
    ).otherwise(partkey)
    given = F.when(F.col("eid") % 4 != 0, F.concat(F.lit("G"), (F.col("eid") % 9).cast("string")))
    no_afids = F.array().cast("array<long>")

    def slot(start, k):
        end = F.coalesce(F.get("parts", k + 1), F.size("by_part"))
        mine = F.slice("by_part", start + 1, end - start)
        first = F.get("by_part", start)
        name, size = first["p_name"], first["p_size"]
        # nearly every part has one line in a paper, which needs no lists
        alone = end - start == 1
        lines = F.array_min(F.transform(mine, lambda x: x["line"]))
        afids = F.sort_array(
            F.array_distinct(
                F.filter(F.transform(mine, lambda x: x["afid"]), lambda afid: afid.isNotNull())
            )
        )
        own = F.when(first["afid"].isNotNull(), F.array(first["afid"])).otherwise(no_afids)
        return F.struct(
            F.when(alone, first["line"]).otherwise(lines).alias("line"),
            auid(first["partkey"]).alias("auid"),
            # what sorts equal lines and authors
            F.when(size % 11 != 0, name).alias("surname_pn"),
            F.when(size % 3 != 0, F.lit("I.")).alias("initials_pn"),
            F.when(size % 5 != 0, F.concat(name, F.lit(" P"))).alias("indexed_name_pn"),
            F.concat(name, F.lit(" X")).alias("indexed_name"),
            F.when(alone, own).otherwise(afids).alias("afids"),
        )

    # affiliations of a paper: its distinct suppliers in id order
    def affiliation(start):
        home = F.get("by_home", start)
        return F.struct(
            home["afid"].alias("afid"),
            F.when(home["afid"] % 9 == 0, F.array().cast("array<string>")).otherwise(
                F.array(F.concat(F.lit("Dept "), (F.col("eid") % 3).cast("string")), home["s_name"])
            ).alias("affiliation_organization"),
            home["n_name"].alias("affiliation_tag_country"),
        )

    papers = papers.select(
        "eid", "o_orderdate", "o_orderpriority", given.alias("given"),
        F.when(F.size("parts") > 0, F.sort_array(F.transform("parts", slot))).alias("slots"),
        F.when(F.size("homes") > 0, F.transform("homes", affiliation)).alias("Af"),
        F.when(
            F.size("homes") > 0, F.transform("homes", lambda start: F.get("by_home", start)["afid"])
        ).alias("afids"),
    )
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "ar")
        .when(F.col("o_orderpriority") == "2-HIGH", "cp")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "re")
        .otherwise("ed")
    )
    collection = (
        F.when(F.col("eid") % 10 == 0, "PP").when(F.col("eid") % 3 == 0, "MEDL").otherwise("CORE")
    )
    people = F.transform(
        "slots",
        lambda s, i: F.struct(
            s["auid"].cast("string").alias("auid"),
            (i + 1).alias("Authorseq"),
            F.col("given").alias("given_name_pn"),
            *[s[n].alias(n) for n in ("surname_pn", "initials_pn", "indexed_name_pn", "indexed_name")],
        ),
    )
    links = F.flatten(
        F.transform(
            "slots",
            lambda s, i: F.transform(
                s["afids"],
                lambda afid: F.struct(
                    (i + 1).alias("Authorseq"),
                    F.array_position("afids", afid).cast("int").alias("affiliation_seq"),
                ),
            ),
        )
    )
    papers = papers.select(
        "eid",
        F.year("o_orderdate").alias("year"),
        F.to_date("o_orderdate").alias("datesort"),
        kind.alias("publication_type"),
        F.array(collection).alias("dbcollections"),
        _references(F.col("eid")).alias("references"),
        F.struct((F.col("eid") % 97).alias("srcid")).alias("source"),
        people.alias("Au"),
        links.alias("Au_af"),
        F.col("Af").alias("Af"),
    )
    # a cast that changes no more than what may be missing would still rebuild every list
    return papers.select(*[
        F.col(f.name).alias(f.name)
        if papers.schema[f.name].dataType.simpleString() == f.dataType.simpleString()
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in schemas.PUBLICATIONS.fields
    ])


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 4 != 0).select(
        F.col("s_suppkey").alias("afid"),
        F.concat(F.lit("Inst "), "s_name").alias("preferred_name"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    region = _table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(F.col("r_regionkey") < 2, "A").otherwise("B").alias("domain"),
        F.col("r_name").alias("field"),
        F.col("n_name").alias("subfield"),
    )


def paper_subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw label per paper, in another case and padded; some papers have none."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        orders.filter(F.col("o_orderkey") % 11 != 0)
        .join(homes, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("eid"),
            F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("subfield_hybrid"),
        )
    )


def discontinued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven source ids, one of each of the first nations."""
    nation = _table(spark, sf_dir, "nation").filter("n_nationkey < 7")
    return nation.select(F.col("n_nationkey").cast("long").alias("srcid"))


def _root(spark: SparkSession, sf_dir: str) -> str:
    """One folder per application and data folder: no run sees another's stages."""
    app = spark.sparkContext.applicationId
    return f"{scratch_folder(spark)}/laurel-{app}/{os.path.basename(sf_dir.rstrip('/'))}"


def inputs(spark: SparkSession, sf_dir: str, root: str | None = None) -> Inputs:
    """The five input tables, written once per application as a database would hold them."""
    tasks = partitions(spark, sf_dir)
    store = StageStore(spark, root or _root(spark, sf_dir), sf_dir, tasks)
    publication_table = store.path("publications", CONFIG, PUBLICATION_LAYOUT)
    store.get_or_build(
        "publications",
        CONFIG,
        lambda: publications(
            spark,
            sf_dir,
            store.get_or_build("homes", CONFIG, lambda: homes(spark, sf_dir)),
            store.buckets,
        ),
        PUBLICATION_LAYOUT,
    )
    tables = {
        "paper_subfields": lambda: paper_subfields(spark, sf_dir),
        "labels": lambda: labels(spark, sf_dir),
        "institutions": lambda: institutions(spark, sf_dir),
        "discontinued": lambda: discontinued(spark, sf_dir),
    }
    for name, build in tables.items():
        store.get_or_build(name, CONFIG, build)
    names = readers.read_labels(spark, store.path("labels", CONFIG))
    return Inputs(
        publications=readers.read_publications(
            spark, publication_table, table=store.table_name(publication_table)
        ),
        institutions=readers.read_institutions(spark, store.path("institutions", CONFIG)),
        classification=readers.read_classification(
            spark, store.path("paper_subfields", CONFIG), names
        ),
        labels=names,
        discontinued=readers.read_discontinued(spark, store.path("discontinued", CONFIG)),
        partitions=tasks,
    )


def pipeline(
    spark: SparkSession, sf_dir: str, cfg: MetricConfig = CONFIG, root: str | None = None
) -> Pipeline:
    root = root or _root(spark, sf_dir)
    return Pipeline(spark, inputs(spark, sf_dir, root), cfg, root, version=sf_dir)
