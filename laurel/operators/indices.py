"""h-index and co-author-adjusted hm-index.

Both walk an author's papers by citations (most first, then paper id). With
``r`` the position of a paper and ``r_eff`` the running sum of 1/authors, h is
the largest ``r`` and hm the largest ``r_eff`` that do not exceed the citations
of their paper. Repeated (author, paper) rows are ties: they share both values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.spread import running_totals

BASES = ("ns", "ws")

# Shares such as 1/3 are decimals of this many places, so their sums are exact and
# do not depend on the order of addition. A sum that equals a citation count
# mathematically must not miss it by what the last place of each share lacks.
SHARE_PLACES = 15
TOLERANCE = 1e-9
DECIMALS = 9

# On the spread path 64-bit paper ids are ordered 16 bits at a time, so that no
# window holds more than 2**16 rows however the ids are distributed. Authors with
# no more rows than that need no levels.
ID_LEVELS = (48, 32, 16)
WINDOW_ROWS = 1 << 16


def share_of_paper() -> Column:
    """One author's share of a paper."""
    share = F.lit(1).cast("decimal(17,15)") / F.col("n_authors").cast("decimal(10,0)")
    return F.round(share, SHARE_PLACES).cast(f"decimal(16,{SHARE_PLACES})")


def kept_rows(cfg: MetricConfig) -> Column:
    """Rows inside the optional overall lower year.

    Positions are always taken over all rows; only the maximum is restricted.
    """
    if cfg.overall_min_year is None:
        return F.lit(True)
    return F.col("year") >= cfg.overall_min_year


def with_positions(rows: DataFrame) -> DataFrame:
    """Add ``<basis>_r`` and ``<basis>_r_eff`` for both bases."""
    for basis in BASES:
        order = Window.partitionBy("auid").orderBy(F.col(f"{basis}_cites").desc(), "eid")
        rows = rows.withColumn(f"{basis}_r", F.rank().over(order)).withColumn(
            f"{basis}_r_eff", F.sum(share_of_paper()).over(order).cast("double")
        )
    return rows


def h_of(position: Column, cites: Column, kept: Column) -> Column:
    return F.max(F.when(kept & (position <= cites), position.cast("long")).otherwise(F.lit(0)))


def hm_of(r_eff: Column, cites: Column, kept: Column) -> Column:
    best = F.max(F.when(kept & (r_eff <= cites + TOLERANCE), r_eff).otherwise(F.lit(0.0)))
    return F.round(best, DECIMALS)


def index_aggregates(cfg: MetricConfig) -> list[Column]:
    """h and hm of both bases over rows that carry their positions."""
    kept = kept_rows(cfg)
    aggregates = []
    for basis in BASES:
        cites = F.col(f"{basis}_cites")
        aggregates.append(h_of(F.col(f"{basis}_r"), cites, kept).alias(f"{basis}_h"))
        aggregates.append(hm_of(F.col(f"{basis}_r_eff"), cites, kept).alias(f"{basis}_hm"))
    return aggregates


def author_indices(rows: DataFrame, cfg: MetricConfig) -> DataFrame:
    """``ns_h``, ``ns_hm``, ``ws_h``, ``ws_hm`` per author from windows over the author."""
    return with_positions(rows).groupBy("auid").agg(*index_aggregates(cfg))


def author_indices_spread(
    rows: DataFrame, cfg: MetricConfig, id_levels: Sequence[int] = ID_LEVELS
) -> DataFrame:
    """Same result for authors with too many rows for one task.

    The order is cut into citations and then 16 bits of the id at a time, so no
    window holds more than the distinct citation counts of an author or 2**16 ids;
    without ``id_levels`` it holds the ids that share a citation count. Papers with as
    many citations are ordered among each other only if the first of them can still
    count: in all others both positions are past their citations.
    """
    kept = kept_rows(cfg)
    ranges = [f"_id_{bits}" for bits in id_levels]
    by_basis = rows.select(
        "auid",
        "eid",
        *[F.shiftright("eid", bits).alias(f"_id_{bits}") for bits in id_levels],
        share_of_paper().alias("share"),
        kept.alias("kept"),
        F.explode(
            F.array(*[
                F.struct(F.lit(b).alias("basis"), F.col(f"{b}_cites").alias("cites"))
                for b in BASES
            ])
        ).alias("_b"),
    ).select("auid", "eid", *ranges, "share", "kept", "_b.basis", "_b.cites")
    cells = by_basis.groupBy("auid", "basis", "cites", *ranges, "eid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"), F.max("kept").alias("kept")
    )
    placed = running_totals(
        cells,
        ["auid", "basis"],
        [("cites", "desc"), *[(r, "asc") for r in ranges], ("eid", "asc")],
        ["n", "share"],
        F.coalesce(
            (F.col("n_before") < F.col("cites"))
            | (F.col("share_before").cast("double") <= F.col("cites") + TOLERANCE),
            F.lit(True),
        ),
    )
    position = F.col("n_before") + 1
    r_eff = (F.col("share_before") + F.col("share")).cast("double")
    per_basis = placed.groupBy("auid", "basis").agg(
        h_of(position, F.col("cites"), F.col("kept")).alias("h"),
        hm_of(r_eff, F.col("cites"), F.col("kept")).alias("hm"),
    )
    return per_basis.groupBy("auid").agg(*[
        F.max(F.when(F.col("basis") == b, F.col(v))).alias(f"{b}_{v}")
        for b in BASES
        for v in ("h", "hm")
    ])
