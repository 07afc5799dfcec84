"""Dominant institution of an author's last year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.bloom import held
from laurel.functions.columns import author_id, author_slots
from laurel.functions.spread import spread_join


def author_affiliations(publications: DataFrame, cfg: MetricConfig) -> DataFrame:
    """One row per (paper, author, affiliation) link with a printed organisation.

    The links of a paper are unfolded and take their affiliation by its place. In a paper
    whose slots stand in the order of their positions 1, 2, 3, ..., as nearly all do, a link
    takes its author by place too, and nothing is shuffled. The links of the other papers
    meet their slots in a join by paper and position, linear in the links and not in links
    times authors. A link that points past a list is dropped; a position that several slots
    share belongs to each of them.
    """
    in_order = in_order_of_position()
    regular = linked_affiliations(publications.filter(in_order), cfg, by_place=True)
    others = publications.filter(~in_order)
    slots = others.select("eid", F.explode(author_slots()).alias("_a")).select(
        "eid", F.col("_a.Authorseq").alias("_seq"), author_id(F.col("_a.auid")).alias("auid")
    )
    joined = linked_affiliations(others, cfg, by_place=False).join(
        slots.filter(F.col("auid").isNotNull()), ["eid", "_seq"]
    )
    columns = ["eid", "year", "datesort", "auid", "affil_id", "cntry", "affil_name"]
    return (
        regular.select(*columns[:-1], "_organization")
        .unionByName(joined.select(*columns[:-1], "_organization"))
        .withColumn("affil_name", F.array_join("_organization", ", "))
        .select(*columns)
    )


def in_order_of_position() -> Column:
    """Whether each author slot of a paper stands at the place its position names."""
    sequence = F.col("Au.Authorseq")
    return F.coalesce(
        sequence == F.when(F.size(sequence) > 0, F.sequence(F.lit(1), F.size(sequence))),
        F.lit(False),
    )


def linked_affiliations(publications: DataFrame, cfg: MetricConfig, by_place: bool) -> DataFrame:
    """The links that lead to a printed organisation, with ``auid`` by place or ``_seq`` to join by."""
    seq = lambda link: link["Authorseq"]
    author = (
        (lambda link: author_id(F.get(F.col("Au.auid"), seq(link) - 1))) if by_place else seq
    )
    name = "auid" if by_place else "_seq"
    linked = F.transform(
        "Au_af",
        lambda link: F.struct(
            author(link).alias(name),
            F.get(F.col("Af"), link["affiliation_seq"] - 1).alias("affiliation"),
        ),
    )
    return (
        publications.select(
            "eid", F.col(cfg.year_column).alias("year"), "datesort", F.explode(linked).alias("_l")
        )
        .select(
            "eid",
            "year",
            "datesort",
            F.col(f"_l.{name}").alias(name),
            F.col("_l.affiliation.afid").alias("affil_id"),
            F.col("_l.affiliation.affiliation_organization").alias("_organization"),
            F.col("_l.affiliation.affiliation_tag_country").alias("cntry"),
        )
        .filter((F.size("_organization") > 0) & F.col(name).isNotNull())
    )


def last_affiliated_years(affiliations: DataFrame) -> DataFrame:
    """The year that decides on the institution of each author, with its ``_key``: two numbers an author."""
    return (
        affiliations.groupBy("auid")
        .agg(F.max("year").alias("year"))
        .withColumn("_key", F.xxhash64("auid", "year"))
    )


def dominant_affiliation(
    affiliations: DataFrame, wanted: DataFrame | None = None, last: DataFrame | None = None
) -> DataFrame:
    """The most frequent affiliation of each author's last affiliated year.

    Ties: latest date, then lowest id. Printed name and country come from the
    latest record of that affiliation. Both steps are maxima over pre-aggregated
    rows, so no author's links are ever gathered in one place. ``wanted`` (from ``id_filter``)
    keeps other authors, but for its error, out of both; ``last`` (from ``id_filter`` on the
    ``_key`` of ``last_affiliated_years``) keeps the links of earlier years out, which decide nothing.
    """
    links = affiliations.filter(held(wanted, F.col("auid")))
    if last is not None:
        links = links.filter(held(last, F.xxhash64("auid", "year")))
    per_affiliation = links.groupBy("auid", "year", "affil_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("datesort", "eid", "affil_name", "cntry")).alias("_latest"),
    )
    choice = F.struct(
        "year",
        "n",
        F.col("_latest.datesort").alias("max_datesort"),
        F.col("affil_id").isNull().alias("_no_id"),
        F.bitwise_not("affil_id").alias("_lowest"),
        "affil_id",
        F.col("_latest.affil_name").alias("affil_name"),
        F.col("_latest.cntry").alias("cntry"),
    )
    return (
        per_affiliation.groupBy("auid")
        .agg(F.max(choice).alias("_c"))
        .select("auid", "_c.affil_id", "_c.affil_name", "_c.cntry", "_c.max_datesort")
    )


def author_institution(
    chosen: DataFrame, institutions: DataFrame, hot_institutions: DataFrame | None = None
) -> DataFrame:
    """Add the preferred institution name, else the name as printed.

    ``hot_institutions`` (from ``hot_keys`` on ``affil_id``) spreads institutions
    with very many authors.
    """
    preferred = institutions.select(F.col("afid").alias("affil_id"), "preferred_name")
    named = spread_join(chosen, preferred, ["affil_id"], hot_institutions, "auid", "left", written=True)
    return named.select(
        "auid",
        "affil_id",
        "affil_name",
        "cntry",
        "max_datesort",
        "preferred_name",
        F.coalesce("preferred_name", "affil_name").alias("inst_name"),
    )
