"""Counts and percentile cut-offs per subfield, per field and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.ranks import value_ranks
from laurel.functions.columns import sum_if
from laurel.operators.ranking import Save, is_top_listed, unsaved

# Published percentiles.
WIDE_POINTS = (25, 50, 75, 90, 95, 99)
HIGH_POINTS = (95, 99)

# output prefix -> (column, percentiles, only inside the top list)
MEASURES = {
    "cites": ("ws_nc", WIDE_POINTS, False),
    "c": ("ws_c", WIDE_POINTS, False),
    "self_share": ("self_share", HIGH_POINTS, False),
    "cite_ratio": ("ws_cite_ratio", HIGH_POINTS, False),
    "cite_ratio_ns": ("ns_cite_ratio", HIGH_POINTS, False),
    "top_self_share": ("self_share", HIGH_POINTS, True),
    "top_cite_ratio": ("ws_cite_ratio", HIGH_POINTS, True),
    "top_cite_ratio_ns": ("ns_cite_ratio", HIGH_POINTS, True),
}

LEVELS = ("subfield", "field", "total")
TOTAL = "TOTAL"

# First-pass cells are 2**-8 wide: few enough to count, fine enough that the
# second pass reads a small part of the values.
COARSE_BITS = 8

_BY = ["level", "subject", "assigned"]


def _subjects(levels):
    """(level, subject, assigned) entries; authors without a subject form their own group."""
    columns = {"subfield": F.col("subfield_1"), "field": F.col("field_1"), "total": F.lit(TOTAL)}
    return F.explode(
        F.array(*[
            F.struct(
                F.lit(level).alias("level"),
                F.coalesce(columns[level], F.lit("")).alias("subject"),
                columns[level].isNotNull().alias("assigned"),
            )
            for level in levels
        ])
    )


def threshold_values(ranked: DataFrame) -> DataFrame:
    """How many authors of a (subfield, field) have each value of each measure.

    The finest groups there are: those of every level are unions of them, so counts of
    fields and of the total come from adding up, never from listing an author again.
    ``ranked`` is read once; both passes over the values start from this table.
    """
    entries = []
    for prefix, (column, _, top_only) in MEASURES.items():
        value = F.col(column).cast("double")
        if top_only:
            value = F.when(F.col("top_listed"), value)
        entries.append(F.struct(F.lit(prefix).alias("measure"), value.alias("value")))
    measures = F.filter(F.array(*entries), lambda m: m["value"].isNotNull())
    return (
        ranked.select("subfield_1", "field_1", F.explode(measures).alias("_m"))
        .groupBy("subfield_1", "field_1", "_m.measure", "_m.value")
        .agg(F.count(F.lit(1)).alias("n_authors"))
    )


def _with_cells(values: DataFrame) -> DataFrame:
    # values are never NULL; declared so, in order that the plan's branches share shuffles
    return values.withColumn("value", F.coalesce("value", F.lit(0.0))).withColumn(
        "cell",
        F.coalesce(
            F.floor(F.col("value") * float(1 << COARSE_BITS)).cast("long"),
            F.lit(0).cast("long"),
        ),
    )


def subject_cells(values: DataFrame, levels=LEVELS) -> DataFrame:
    """Authors per coarse cell of each subject and measure: a histogram per subject.

    Counted per (subfield, field) first; only these counts are listed for each level and
    merged, a few rows per subject whatever the number of authors.
    """
    finest = (
        _with_cells(values)
        .groupBy("subfield_1", "field_1", "measure", "cell")
        .agg(F.sum("n_authors").alias("n"))
    )
    return (
        finest.select("measure", "cell", "n", _subjects(levels).alias("_s"))
        .groupBy("_s.level", "_s.subject", "_s.assigned", "measure", "cell")
        .agg(F.sum("n").alias("n"))
    )


def _reaches(above, total, point):
    """Upper bound of the percentile range at or past the point."""
    return (total - above) / total >= point


def cutoff_cells(histograms: DataFrame) -> DataFrame:
    """The coarse cell in which each cut-off lies, with the rows above that cell."""
    group = Window.partitionBy(*_BY, "measure")
    above = group.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    points = F.create_map(*[
        part
        for prefix, (_, wanted, _) in MEASURES.items()
        for part in (F.lit(prefix), F.array(*[F.lit(p) for p in wanted]))
    ])
    return (
        histograms.withColumn("cell_above", F.coalesce(F.sum("n").over(above), F.lit(0)))
        .withColumn("n_values", F.sum("n").over(group))
        .withColumn("point", F.explode(points[F.col("measure")]))
        .filter(_reaches(F.col("cell_above"), F.col("n_values"), F.col("point") / 100.0))
        .groupBy(*_BY, "measure", "point")
        .agg(F.min(F.struct("cell", "cell_above", "n_values")).alias("_c"))
        .select(*_BY, "measure", "point", "_c.*")
    )


def percentile_cutoffs(values: DataFrame, levels=LEVELS, save: Save = unsaved) -> DataFrame:
    """Exact cut-offs: the least value whose inverse rank position reaches the percentile.

    Pass one merges histograms of coarse cells and finds the few that hold a cut-off.
    Pass two orders only the values inside those cells. ``n_reached``
    is the number of rows at or above the cut-off.
    """
    cells = save("threshold_cells", cutoff_cells(subject_cells(values, levels)))
    keys = [*_BY, "measure", "cell"]
    listed = _with_cells(values).select(
        _subjects(levels).alias("_s"), "measure", "cell", "value", "n_authors"
    ).select("_s.*", "measure", "cell", "value", "n_authors")
    inside = listed.join(cells.select(*keys).distinct(), keys)
    ranks = value_ranks(inside, keys, "value", blocks=False, times="n_authors").select(*keys, "value", "n", "n_before")
    return (
        ranks.join(cells, keys)
        .filter(
            _reaches(
                F.col("cell_above") + F.col("n_before"), F.col("n_values"), F.col("point") / 100.0
            )
        )
        .groupBy(*_BY, "measure", "point")
        .agg(
            F.min("value").alias("cutoff"),
            (F.max("cell_above") + F.sum("n")).alias("n_reached"),
        )
    )


def subject_thresholds(
    ranked: DataFrame, cfg: MetricConfig, levels=LEVELS, save: Save = unsaved
) -> DataFrame:
    """One row per subject of every level: author counts and cut-offs.

    ``subject`` is NULL for authors without one and ``TOTAL`` on the total level.
    """
    ranked = ranked.withColumn("top_listed", is_top_listed(cfg))
    counts = (
        ranked.select("ns_rank", "ws_rank", "top_listed", _subjects(levels).alias("_s"))
        .groupBy("_s.level", "_s.subject", "_s.assigned")
        .agg(
            F.count(F.lit(1)).alias("n_authors"),
            sum_if(F.col("ns_rank") <= cfg.rank_cutoff).alias("n_top_rank_ns"),
            sum_if(F.col("ws_rank") <= cfg.rank_cutoff).alias("n_top_rank"),
            F.sum(F.when(F.col("top_listed"), F.lit(1).cast("long"))).alias("n_top_list"),
        )
    )
    columns = []
    for prefix, (column, points, top_only) in MEASURES.items():
        for point in points:
            here = (F.col("measure") == prefix) & (F.col("point") == point)
            cutoff = F.max(F.when(here, F.col("cutoff")))
            if column == "ws_nc":
                cutoff = cutoff.cast("long")
            columns.append(cutoff.alias(f"{prefix}_{point}"))
    for prefix, (_, points, top_only) in MEASURES.items():
        if top_only:
            for point in points:
                here = (F.col("measure") == prefix) & (F.col("point") == point)
                reached = F.coalesce(F.max(F.when(here, F.col("n_reached"))), F.lit(0))
                columns.append(reached.alias(f"n_{prefix}_{point}"))
    values = save("threshold_values", threshold_values(ranked))
    cutoffs = percentile_cutoffs(values, levels, save).groupBy(*_BY).agg(*columns)
    joined = counts.join(cutoffs, _BY, "left")
    # a subject whose authors have no value at all still counts 0 beyond a cut-off
    joined = joined.na.fill(
        0, [f"n_{p}_{pt}" for p, (_, pts, top) in MEASURES.items() if top for pt in pts]
    )
    return joined.withColumn(
        "subject", F.when(F.col("assigned"), F.col("subject"))
    ).drop("assigned")


def with_total(thresholds: DataFrame, level: str) -> DataFrame:
    """The rows of one level followed by the TOTAL row, keyed by ``subject``."""
    wanted = thresholds.filter(F.col("level") == level)
    return wanted.unionByName(thresholds.filter(F.col("level") == "total")).drop("level")
