"""Latest display name and publication span per author."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.bloom import held
from laurel.functions.columns import author_id, display_name


def author_names(
    publications: DataFrame, cfg: MetricConfig, wanted: DataFrame | None = None
) -> DataFrame:
    """Name from the best record of each author, first and last year over all papers.

    Records with a given name win, then the latest date, the highest paper id and
    the highest author position. The best record is a maximum, so a prolific
    author is reduced on the map side and never sorted as a group. ``wanted`` (from
    ``id_filter``) keeps other authors, but for its error, out of the aggregation.
    """
    slots = publications.select(
        "eid", "datesort", F.col(cfg.year_column).alias("year"), F.explode("Au").alias("_author")
    )
    record = F.struct(
        F.col("_author.given_name_pn").isNotNull().alias("has_given"),
        "datesort",
        "eid",
        F.col("_author.Authorseq").alias("seq"),
        display_name(F.col("_author")).alias("name"),
    )
    return (
        slots.withColumn("auid", author_id(F.col("_author.auid")))
        .filter(F.col("auid").isNotNull() & held(wanted, F.col("auid")))
        .groupBy("auid")
        .agg(
            F.max(record).alias("_best"),
            F.min("year").alias("first_pub_year"),
            F.max("year").alias("last_pub_year"),
        )
        .select(
            "auid",
            F.col("_best.eid").alias("name_eid"),
            F.col("_best.name").alias("authfull"),
            "first_pub_year",
            "last_pub_year",
        )
    )
