"""All per-author counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.columns import sum_if
from laurel.functions.spread import any_of, hot_keys, list_join, spread_join
from laurel.operators.indices import (
    BASES,
    ID_LEVELS,
    WINDOW_ROWS,
    author_indices_spread,
    index_aggregates,
    kept_rows,
    with_positions,
)
from laurel.operators.ranking import Save, unsaved


def count_aggregates(cfg: MetricConfig) -> dict[str, Column]:
    """Named sums of the profile: paper counts, citation totals, author positions."""
    kept = kept_rows(cfg)
    in_range = kept & F.col("year").between(cfg.min_year, cfg.max_year)
    alone = F.col("n_authors") == 1
    first = alone | (F.col("author_seq") == 1)
    first_or_last = first | (F.col("author_seq") == F.col("n_authors"))
    discontinued = F.col("is_discontinued") == 1
    sums = {
        "n_core": sum_if(F.col("is_core")),
        "np": sum_if(kept),
        "np_range": sum_if(in_range),
        "np_discontinued": sum_if(kept & discontinued),
        "np_range_discontinued": sum_if(in_range & discontinued),
        "ws_nc_discontinued": sum_if(kept, F.col("discontinued_cites")),
    }
    for b in BASES:
        cites = F.col(f"{b}_cites")
        sums[f"{b}_nc"] = sum_if(kept, cites)
        sums[f"{b}_npc"] = sum_if(kept & (cites > 0))
        sums[f"{b}_npc_range"] = sum_if(in_range & (cites > 0))
        for name, where in (("s", alone), ("sf", first), ("sfl", first_or_last)):
            sums[f"{b}_np{name}"] = sum_if(kept & where)
            sums[f"{b}_nc{name}"] = sum_if(kept & where, cites)
    return sums


def _enough(profile: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Core-paper minimum over all years; then at least one paper must remain."""
    return profile.filter(
        (F.col("n_core") >= cfg.min_core_papers) & (F.col("np") > 0)
    )


def paper_metrics(
    rows: DataFrame, cfg: MetricConfig, hot_authors: DataFrame | None = None
) -> DataFrame:
    """Counts, h and hm per author, for authors with enough core papers.

    One shuffle by author serves the two windows and the aggregation after them.
    ``hot_authors`` (from ``hot_keys`` on ``auid``) lists authors with more rows
    than one task should hold; they are pre-aggregated and ranked level by level, with
    levels of the paper id if one of them has more rows than a window should hold.
    """
    sums = [c.alias(name) for name, c in count_aggregates(cfg).items()]
    rows = rows.drop("subfield", "field")
    usual, hot = rows, None
    if hot_authors is not None:
        usual = list_join(rows, hot_authors, "auid", "left_anti")
        hot = list_join(rows, hot_authors, "auid", "left_semi")
    profile = with_positions(usual).groupBy("auid").agg(*sums, *index_aggregates(cfg))
    if hot is not None:
        most = (hot_authors.agg(F.max("_slices")).first()[0] or 0) * cfg.hot_key_rows
        indices = author_indices_spread(hot, cfg, ID_LEVELS if most > WINDOW_ROWS else ())
        spread = hot.groupBy("auid").agg(*sums).join(indices, "auid")
        profile = profile.unionByName(spread)
    return _enough(profile, cfg)


def distinct_citing(
    rows: DataFrame,
    edges: DataFrame,
    cfg: MetricConfig,
    save: Save = unsaved,
    partitions: int | None = None,
) -> DataFrame:
    """Distinct papers citing an author's papers, ns and ws.

    Works on (author, citing paper) pairs instead of id lists per author. Pairs that are the same
    come from different papers and so rarely meet before the exchange; ``partitions`` deals them
    over so many tasks, however few Spark would join them to. Authors without citations are absent. A paper makes as
    many pairs as it has citations times authors; one with more than
    ``hot_key_rows`` is cut into slices of its citing papers. With written stages (``save``)
    and no such paper the edges stay in their buckets.
    """
    papers = rows.filter(kept_rows(cfg) & (F.col("ws_cites") > 0))
    # a paper has no more authors than its list: most need no counting (an id listed several
    # times may pass the limit so many times over)
    many = papers.filter(F.col("ws_cites") * F.col("n_authors") > cfg.hot_key_rows)
    made = many.groupBy("eid").agg((F.max("ws_cites") * F.count(F.lit(1))).alias("n_pairs"))
    hot = save("hot_pairs", hot_keys(made, ["eid"], "n_pairs", cfg.hot_key_rows))
    cited = edges.select(F.col("cited_eid").alias("eid"), "citing_eid", "is_self")
    met = spread_join(
        cited,
        papers.select("auid", "eid"),
        ["eid"],
        hot if save is unsaved else any_of(hot),
        "citing_eid",
        written=save is not unsaved,
    ).select("auid", "citing_eid", "is_self")
    if partitions is not None:
        met = met.repartition(partitions, "auid", "citing_eid")
    pairs = met.groupBy("auid", "citing_eid").agg(F.min("is_self").alias("is_self"))
    return pairs.groupBy("auid").agg(
        sum_if(F.col("is_self") == 0).alias("ns_nc_citing"),
        F.count(F.lit(1)).alias("ws_nc_citing"),
    )


def author_profile(metrics: DataFrame, citing: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per author: metrics, distinct citing papers, subject arrays."""
    return (
        metrics.join(citing, "auid", "left")
        .na.fill(0, ["ns_nc_citing", "ws_nc_citing"])
        .join(subjects, "auid", "left")
    )
