"""Global and within-subfield ranks, the ranked author table, the top list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.columns import ratio
from laurel.functions.ranks import value_ranks
from laurel.functions.spread import hot_keys, spread_join
from laurel.operators.indices import BASES
from laurel.operators.score import ratios
from laurel.operators.subjects import top_subjects

Save = Callable[[str, DataFrame], DataFrame]

# A score is never negative, so this value sorts a missing score last.
NO_SCORE = -1.0


def unsaved(name: str, df: DataFrame) -> DataFrame:
    return df


def eligible_authors(scored: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Authors that take part in the ranking, with ratios and main subjects."""
    kept = scored.filter(
        F.col("auid").isNotNull() & (F.col("np_range") >= cfg.min_ranked_papers)
    )
    return top_subjects(ratios(kept))


def score_ranks(authors: DataFrame, cfg: MetricConfig, save: Save = unsaved) -> DataFrame:
    """``<basis>_rank``, ``<basis>_subfield_rank`` and ``subfield_count`` per author.

    Higher scores first, ties share a rank, missing scores last; no subfield rank
    without a subfield. All four rankings are one pass: every author is listed once
    per ranking, equal scores collapse before they are ordered, and the ranks are
    joined back with frequent scores spread over several tasks.
    """
    in_subfield = F.col("subfield_1").isNotNull()
    everyone = F.lit("all")
    own = F.concat(F.lit("="), F.coalesce("subfield_1", F.lit("")))
    entries = [
        F.struct(
            F.lit(b).alias("basis"),
            scope.alias("scope"),
            F.coalesce(F.col(f"{b}_c"), F.lit(NO_SCORE)).alias("score"),
        )
        for scope in (everyone, own)
        for b in BASES
    ]
    listed = authors.select(
        "auid",
        F.explode(
            F.when(in_subfield, F.array(*entries)).otherwise(F.array(*entries[: len(BASES)]))
        ).alias("_e"),
    ).select("auid", "_e.*")
    on = ["basis", "scope", "score"]
    ranks = save("score_ranks", value_ranks(listed, ["basis", "scope"], "score"))
    placed = spread_join(
        listed,
        ranks.select(*on, (F.col("n_before") + 1).alias("rank"), "n_group"),
        on,
        hot_keys(ranks, on, "n", cfg.hot_key_rows),
        "auid",
        written=save is not unsaved,
    )
    glob = F.col("scope") == "all"
    columns = []
    for b in BASES:
        mine = F.col("basis") == b
        columns.append(F.max(F.when(mine & glob, F.col("rank"))).alias(f"{b}_rank"))
        columns.append(F.max(F.when(mine & ~glob, F.col("rank"))).alias(f"{b}_subfield_rank"))
    columns.append(F.max(F.when(~glob, F.col("n_group"))).alias("subfield_count"))
    return placed.groupBy("auid").agg(*columns)


def rank_authors(
    scored: DataFrame,
    names: DataFrame,
    institutions: DataFrame,
    cfg: MetricConfig,
    save: Save = unsaved,
) -> DataFrame:
    """The ranked author table: metrics, ratios, subjects, ranks, name, institution."""
    authors = eligible_authors(scored, cfg)
    return (
        authors.join(score_ranks(authors, cfg, save), "auid", "left")
        .join(names, "auid", "left")
        .join(institutions, "auid", "left")
        .withColumnRenamed("auid", "author_id")
    )


def is_top_listed(cfg: MetricConfig) -> Column:
    """In the first ``rank_cutoff`` ranks, or in the best share of the own subfield."""
    chosen = F.lit(False)
    for b in BASES:
        chosen = chosen | (F.col(f"{b}_rank") <= cfg.rank_cutoff)
        chosen = chosen | (subfield_position(b) <= cfg.subfield_fraction)
    return F.coalesce(chosen, F.lit(False))


def subfield_position(basis: str) -> Column:
    """Rank inside the subfield as a share of the subfield; NULL without one."""
    return ratio(f"{basis}_subfield_rank", "subfield_count")
