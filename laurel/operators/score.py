"""Log measures, their global maxima and the composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.functions.columns import ratio
from laurel.operators.indices import BASES

# The six measures of the composite score.
MEASURES = ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")


def log_measures(profile: DataFrame) -> DataFrame:
    """Add ``<basis>_log_<measure>`` = ln(measure + 1)."""
    return profile.withColumns({
        f"{b}_log_{m}": F.log(F.col(f"{b}_{m}") + 1) for b in BASES for m in MEASURES
    })


def log_maxima(profile: DataFrame) -> DataFrame:
    """One row: the largest log of each measure over all profiled authors.

    Taken before the ranking filter, so an author who is not ranked can set the scale.
    """
    return log_measures(profile).agg(*[
        F.max(f"{b}_log_{m}").alias(f"{b}_max_log_{m}") for b in BASES for m in MEASURES
    ])


def composite_score(profile: DataFrame, maxima: DataFrame) -> DataFrame:
    """Add logs, fractions of the maxima and the sums ``ns_c`` and ``ws_c`` (0 to 6).

    The one-row maxima enter as a scalar subquery. A maximum of 0 makes the
    fraction and the score NULL.
    """
    limits = maxima.select(F.struct("*").alias("limits")).scalar()
    scored = log_measures(profile).withColumn("_limits", limits)
    scored = scored.withColumns({
        f"{b}_frac_{m}": ratio(f"{b}_log_{m}", F.col(f"_limits.{b}_max_log_{m}"))
        for b in BASES
        for m in MEASURES
    }).drop("_limits")
    totals = {}
    for b in BASES:
        total = F.col(f"{b}_frac_{MEASURES[0]}")
        for m in MEASURES[1:]:
            total = total + F.col(f"{b}_frac_{m}")
        totals[f"{b}_c"] = total
    return scored.withColumns(totals)


def ratios(profile: DataFrame) -> DataFrame:
    """Self-citation share and citations per distinct citing paper."""
    return profile.withColumns({
        "self_share": ratio(F.col("ws_nc") - F.col("ns_nc"), F.col("ws_nc")),
        "ns_cite_ratio": ratio("ns_nc", "ns_nc_citing"),
        "ws_cite_ratio": ratio("ws_nc", "ws_nc_citing"),
    })
