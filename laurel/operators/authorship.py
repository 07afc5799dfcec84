"""From papers to author-on-paper rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.config import CORE_TYPES, MetricConfig
from laurel.functions.columns import (
    author_id,
    author_slots,
    in_collections,
    is_person,
    sum_if,
)
from laurel.operators.citations import flag_discontinued


def counted_publications(publications: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Papers that count towards an author's record."""
    counted = publications.filter(F.col(cfg.year_column) <= cfg.max_year)
    if cfg.include_preprints:
        return counted
    return counted.filter(in_collections("dbcollections", cfg.collections))


def explode_authors(papers: DataFrame) -> DataFrame:
    """One row per author slot, for identified people only.

    ``n_authors`` is the length of the printed author list, placeholders and
    unknown authors included. ``papers`` has the author list as ``slots``; see
    ``author_slots``. All other columns are carried along.
    """
    rest = [c for c in papers.columns if c != "slots"]
    return (
        papers.select(
            *rest, F.size("slots").alias("n_authors"), F.explode("slots").alias("_author")
        )
        .select(
            *rest,
            "n_authors",
            author_id(F.col("_author.auid")).alias("auid"),
            F.col("_author.Authorseq").alias("author_seq"),
        )
        .filter(is_person(F.col("auid")))
    )


def author_papers(
    publications: DataFrame,
    counts: DataFrame,
    classification: DataFrame,
    discontinued: DataFrame,
    cfg: MetricConfig,
) -> DataFrame:
    """Author-on-paper rows with citation counts and subject.

    Counts and subjects are joined while there is still one row per paper; all
    three sides are keyed by ``eid``, and only then are the authors unfolded.
    The field is kept for every publication type, the subfield for core types.
    """
    papers = counted_publications(publications, cfg).select(
        "eid",
        F.col(cfg.year_column).alias("year"),
        F.coalesce(F.col("publication_type").isin(*CORE_TYPES), F.lit(False)).alias("is_core"),
        F.col("source.srcid").alias("_source"),
        author_slots().alias("slots"),
    )
    papers = (
        flag_discontinued(papers, discontinued, F.col("_source"))
        .join(counts.select("eid", "ws_cites", "ns_cites", "discontinued_cites"), "eid", "left")
        .na.fill(0, ["ws_cites", "ns_cites", "discontinued_cites"])
        .join(classification.select("eid", "subfield", "field"), "eid", "left")
    )
    return explode_authors(
        papers.select(
            "eid",
            "year",
            "is_core",
            "is_discontinued",
            "ws_cites",
            "ns_cites",
            "discontinued_cites",
            F.when(F.col("is_core"), F.col("subfield")).alias("subfield"),
            "field",
            "slots",
        )
    )


def author_sizes(rows: DataFrame) -> DataFrame:
    """Author-on-paper rows per author, all and core."""
    return rows.groupBy("auid").agg(
        F.count(F.lit(1)).alias("n_rows"), sum_if(F.col("is_core")).alias("n_core")
    )


def rows_of_core_authors(rows: DataFrame, sizes: DataFrame, cfg: MetricConfig) -> DataFrame:
    """The rows of authors with enough core papers; what is profiled starts from these.

    ``sizes`` is ``author_sizes(rows)``. Authors that are dropped are often most of
    all, so this comes before every window and pair join.
    """
    enough = sizes.filter(F.col("n_core") >= cfg.min_core_papers).select("auid")
    return rows.join(enough, "auid", "left_semi")


def core_authors(rows: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Authors with enough core papers to be profiled."""
    return author_sizes(rows).filter(F.col("n_core") >= cfg.min_core_papers)
