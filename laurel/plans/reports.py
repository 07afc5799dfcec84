"""The published tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.columns import percent, ratio, sum_if
from laurel.functions.ranks import positions, value_ranks
from laurel.functions.spread import hot_keys, spread_join
from laurel.operators.ranking import Save, is_top_listed, subfield_position, unsaved
from laurel.operators.score import MEASURES
from laurel.operators.thresholds import TOTAL, with_total

# The published columns of Table 1 as (label, source, kind, basis,
# description). {a}, {b}, {c} are the two-digit years: papers from, cites from,
# until. Rows marked "*" appear once per basis.
_SELF_EXCLUDED = "self-citations excluded"
_ALL = "all citations"
_PER_BASIS = [
    ("rank", "rank", "int", "rank based on composite score c"),
    ("nc{b}{c}", "nc", "int", "total cites {cites}-{until}"),
    ("h{c}", "h", "int", "h-index as of end-{until}"),
    ("hm{c}", "hm", "dec", "hm-index as of end-{until}"),
    ("nps", "nps", "int", "number of single authored papers"),
    ("ncs", "ncs", "int", "total cites to single authored papers"),
    ("npsf", "npsf", "int", "number of single+first authored papers"),
    ("ncsf", "ncsf", "int", "total cites to single+first authored papers"),
    ("npsfl", "npsfl", "int", "number of single+first+last authored papers"),
    ("ncsfl", "ncsfl", "int", "total cites to single+first+last authored papers"),
    ("c", "c", "dec", "composite score"),
    ("npciting", "nc_citing", "int", "number of distinct citing papers"),
    ("cprat", "cite_ratio", "dec", "ratio of total citations to distinct citing papers"),
    (
        "np{a}{c} cited{b}{c}",
        "npc_range",
        "int",
        "number of papers {papers}-{until} that have been cited at least once",
    ),
]
_BEFORE = [
    ("author_id", "author_id", None, "", None),
    ("authfull", "authfull", None, "", "author name"),
    ("inst_name", "inst_name", None, "", "institution name (large institutions only)"),
    ("cntry", "cntry", None, "", "country associated with most recent institution"),
    ("np{a}{c}", "np_range", "int", "", "# papers {papers}-{until}"),
    ("firstyr", "first_pub_year", "rawint", "", "year of first publication"),
    ("lastyr", "last_pub_year", "rawint", "", "year of most recent publication"),
]
_BETWEEN = [("self%", "self_share", "perc", "", "self-citation percentage")]
_AFTER = [
    (
        "np{a}{c}_d",
        "np_range_discontinued",
        "int",
        "",
        "# papers {papers}-{until} in titles that are discontinued in {database}",
    ),
    (
        "nc{b}{c}_d",
        "ws_nc_discontinued",
        "int",
        "",
        "total cites {cites}-{until} from titles that are discontinued in {database}",
    ),
    (
        "sm-subfield-1",
        "subfield_1",
        None,
        _ALL,
        "top ranked {scheme} category (subfield) for author",
    ),
    ("sm-subfield-1-frac", "subfield_1_frac", "dec", _ALL, "associated category fraction"),
    (
        "sm-subfield-2",
        "subfield_2",
        None,
        _ALL,
        "second ranked {scheme} category (subfield) for author",
    ),
    ("sm-subfield-2-frac", "subfield_2_frac", "dec", _ALL, "associated category fraction"),
    (
        "sm-field",
        "field_1",
        None,
        _ALL,
        "top ranked higher-level {scheme} category (field) for author",
    ),
    ("sm-field-frac", "field_1_frac", "dec", _ALL, "associated category fraction"),
    (
        "rank sm-subfield-1",
        "ws_subfield_rank",
        "int",
        _ALL,
        "rank of c within category sm-subfield-1",
    ),
    (
        "rank sm-subfield-1 (ns)",
        "ns_subfield_rank",
        "int",
        _SELF_EXCLUDED,
        "rank of c (ns) within category sm-subfield-1",
    ),
    (
        "sm-subfield-1 count",
        "subfield_count",
        "int",
        "",
        "total number of authors within category sm-subfield-1",
    ),
]


def _table1_columns(cfg: MetricConfig) -> list[tuple]:
    a, b, c = cfg.label_suffixes
    words = {
        "a": a,
        "b": b,
        "c": c,
        "papers": cfg.min_year,
        "cites": cfg.min_cite_year,
        "until": cfg.max_year,
        "database": cfg.database_name,
        "scheme": cfg.scheme_name,
    }
    rows = [
        *_BEFORE,
        *[(f"{n} (ns)", f"ns_{s}", k, _SELF_EXCLUDED, d) for n, s, k, d in _PER_BASIS],
        *_BETWEEN,
        *[(n, f"ws_{s}", k, _ALL, d) for n, s, k, d in _PER_BASIS],
        *_AFTER,
    ]
    return [
        (n.format(**words), s, k, basis, None if d is None else d.format(**words))
        for n, s, k, basis, d in rows
    ]


def table1_kinds(cfg: MetricConfig) -> dict[str, str]:
    """Column kinds of Table 1 for ``typed_report``."""
    return {name: kind for name, _, kind, _, _ in _table1_columns(cfg) if kind}


TABLE1_ORDER = ("`rank (ns)`", "author_id")


def table1_rows(ranked: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Table 1 without its sort: top-listed authors, labelled by the run's years."""
    columns = []
    for label, source, _, _, _ in _table1_columns(cfg):
        if source == "self_share":
            columns.append(percent(F.col(source), " %").alias(label))
        elif source in ("authfull", "inst_name"):
            columns.append(F.regexp_replace(source, '"', "").alias(label))
        else:
            columns.append(F.col(source).alias(label))
    return ranked.filter(is_top_listed(cfg)).select(*columns)


def table1(ranked: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Table 1: the top list by rank without self-citations (author id breaks ties)."""
    return table1_rows(ranked, cfg).orderBy(*TABLE1_ORDER)


def table1_positions(ranked: DataFrame, cfg: MetricConfig, save: Save) -> DataFrame:
    """Table 1 with each row's place in its order as ``position``, for sinks that keep no order."""
    return positions(table1_rows(ranked, cfg), TABLE1_ORDER, save, "table1_order")


def table2_positions(table2: DataFrame, subject: str, save: Save) -> DataFrame:
    """The same for the Table 2 whose rows are ``Subfield`` or ``Field``."""
    return positions(table2, table2_order(subject), save, f"table2_{subject.lower()}_order")


def table1_dictionary(spark: SparkSession, cfg: MetricConfig) -> DataFrame:
    """FIELD, BASIS, DESCRIPTION of each published column."""
    rows = [(n, basis, d) for n, _, _, basis, d in _table1_columns(cfg) if d is not None]
    return spark.createDataFrame(rows, "FIELD string, BASIS string, DESCRIPTION string")


def short_count(n: int) -> str:
    """100000 -> ``100k``: how a cut-off is named in labels."""
    for size, unit in ((1_000_000, "m"), (1_000, "k")):
        if n and n % size == 0:
            return f"{n // size}{unit}"
    return str(n)


def _threshold_columns(cfg: MetricConfig) -> list:
    first = short_count(cfg.rank_cutoff)
    share = lambda part: percent(ratio(part, "n_authors"))
    columns = [
        F.col("n_authors").alias("#Auth"),
        F.col("n_top_rank_ns").alias(f"#Auth top {first} (ns)"),
        share("n_top_rank_ns").alias(f"% in {first} (ns)"),
        F.col("n_top_rank").alias(f"#Auth top {first}"),
        share("n_top_rank").alias(f"% in {first}"),
        F.col("n_top_list").alias("#Auth in top-list"),
        share("n_top_list").alias("% in top-list"),
    ]
    columns += [F.col(f"cites_{p}").alias(f"Cites@{p}") for p in (25, 50, 75, 90, 95, 99)]
    columns += [F.round(f"c_{p}", 3).alias(f"c@{p}") for p in (25, 50, 75, 90, 95, 99)]
    columns += [
        percent(F.col(f"top_self_share_{p}"), " %").alias(f"top-list self%@{p}") for p in (95, 99)
    ]
    columns += [F.col(f"top_cite_ratio_{p}").alias(f"top-list cprat@{p}") for p in (95, 99)]
    columns += [F.col(f"top_cite_ratio_ns_{p}").alias(f"top-list cprat@{p} (ns)") for p in (95, 99)]
    return columns


# Kinds of the shared threshold columns of Table 2, in order.
_TABLE2_KINDS = (
    ["int", "int", "perc", "int", "perc", "int", "perc"] + ["int"] * 6 + ["dec"] * 6
    + ["perc"] * 2 + ["dec"] * 4
)


def table2_kinds(columns) -> dict[str, str]:
    """Column kinds of either Table 2, from its column names."""
    return dict(zip(columns[-len(_TABLE2_KINDS):], _TABLE2_KINDS))


def table2_order(subject: str) -> list[Column]:
    """Order of a Table 2 whose rows are ``Subfield`` or ``Field``: by domain, the total last."""
    last = F.when(F.col(subject) == TOTAL, F.lit("ZZ")).otherwise(F.col(subject))
    domain = F.coalesce("Domain", F.lit("ZZ"))
    return [domain, last] if subject == "Field" else [domain, F.col("Field").asc_nulls_first(), last]


def table2_subfield(thresholds: DataFrame, labels: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Table 2a: thresholds per subfield with its domain and field; TOTAL comes last."""
    name = F.coalesce("subject", F.lit("Unassigned"))
    named = with_total(thresholds, "subfield").join(
        labels.select(F.col("subfield").alias("subject"), "domain", "field"), "subject", "left"
    )
    return named.select(
        F.col("domain").alias("Domain"),
        F.col("field").alias("Field"),
        name.alias("Subfield"),
        *_threshold_columns(cfg),
    ).orderBy(*table2_order("Subfield"))


def table2_field(thresholds: DataFrame, labels: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Table 2b: thresholds per field with its domain; TOTAL comes last."""
    name = F.coalesce("subject", F.lit("Unassigned"))
    domains = labels.select(F.col("field").alias("subject"), "domain").distinct()
    return (
        with_total(thresholds, "field")
        .join(domains, "subject", "left")
        .select(
            F.col("domain").alias("Domain"), name.alias("Field"), *_threshold_columns(cfg)
        )
        .orderBy(*table2_order("Field"))
    )


def table3(maxima: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Table 3: the maxima needed to work out a composite score by hand."""
    _, b, c = cfg.label_suffixes
    labels = dict(zip(MEASURES, (f"nc{b}{c}", f"h{c}", f"hm{c}", "ncs", "ncsf", "ncsfl")))
    return maxima.select(
        *[F.col(f"ws_max_log_{m}").alias(labels[m]) for m in MEASURES],
        *[F.col(f"ns_max_log_{m}").alias(f"{labels[m]} (ns)") for m in MEASURES],
    )


def table3_kinds(columns) -> dict[str, str]:
    """Column kinds of Table 3: all are decimal numbers."""
    return dict.fromkeys(columns, "dec")


def dataset_stats(ranked: DataFrame, thresholds: DataFrame, cfg: MetricConfig) -> DataFrame:
    """One row: size of the top list and what leaving out self-citations changes.

    x1 and x2: share of the best authors of their subfield (with self-citations)
    who drop below the same share, or below the top 10 %, without them. x3: top-list
    authors whose cites per citing paper reach the 99th percentile of their subfield.
    """
    limits = thresholds.filter(
        (F.col("level") == "subfield") & F.col("subject").isNotNull()
    ).select(F.col("subject").alias("subfield_1"), F.col("top_cite_ratio_99").alias("_limit"))
    share = f"{cfg.subfield_fraction * 100:g}p"
    listed, ws, ns = F.col("top_listed"), subfield_position("ws"), subfield_position("ns")
    best = ws <= cfg.subfield_fraction
    placed = F.col("subfield_1").isNotNull()
    stats = (
        ranked.withColumn("top_listed", is_top_listed(cfg))
        .join(limits, "subfield_1", "left")
        .agg(
            F.count(F.lit(1)).alias("totalcount"),
            sum_if(listed).alias("toplist_count"),
            sum_if(listed & placed).alias("toplist_count_w_subfield"),
            sum_if(best).alias(f"auths_top{share}_ws"),
            sum_if(best & (ns > cfg.subfield_fraction)).alias(f"auths_top{share}_ws_not_ns"),
            sum_if(best & (ns > 0.1)).alias(f"auths_top{share}_ws_not_top_10p_ns"),
            sum_if(listed & (F.col("ws_cite_ratio") >= F.col("_limit"))).alias(
                "x3_cprat_above_p99_top-list"
            ),
            sum_if(listed & placed & F.col("ws_cite_ratio").isNotNull()).alias(
                "toplist_count_w_subfield_w_ws_cprat"
            ),
        )
    )
    return stats.withColumns({
        f"x1_fraction_{share}_ws_{share}_ns_dropout": ratio(
            F.col(f"`auths_top{share}_ws_not_ns`"), F.col(f"`auths_top{share}_ws`")
        ),
        f"x2_fraction_{share}_ws_10p_ns_dropout": ratio(
            F.col(f"`auths_top{share}_ws_not_top_10p_ns`"), F.col(f"`auths_top{share}_ws`")
        ),
        "x3_fraction_above_p99": ratio(
            F.col("`x3_cprat_above_p99_top-list`"), F.col("toplist_count_w_subfield_w_ws_cprat")
        ),
    })


def ratio_distribution(
    ranked: DataFrame,
    cfg: MetricConfig,
    subfield: str | None = None,
    max_ratio: float = 4.0,
    save: Save = unsaved,
) -> DataFrame:
    """Position of each author's cites per citing paper inside the own subfield.

    All subfields at once, or only the named one. Authors without a ratio take no
    position and are not in the denominator. Ratios that many authors share, such as
    1, are spread over several tasks.
    """
    placed = F.col("subfield_1").isNotNull() if subfield is None else F.col("subfield_1") == subfield
    members = ranked.filter(placed & F.col("ws_cite_ratio").isNotNull()).select(
        "subfield_1",
        "author_id",
        "ws_cite_ratio",
        "ws_nc",
        "ws_nc_citing",
        is_top_listed(cfg).alias("top_listed"),
    )
    on = ["subfield_1", "ws_cite_ratio"]
    ranks = value_ranks(members, ["subfield_1"], "ws_cite_ratio")
    if subfield is None:  # counted, cut to the hot ones and joined: not to be worked out each time
        ranks = save("ratio_ranks", ranks)
    below = ranks.select(
        *on, (F.col("n_group") - F.col("n_before") - F.col("n") + 1).alias("_position"), "n_group"
    )
    shown = members.filter(F.col("ws_cite_ratio") < max_ratio)
    hot = hot_keys(ranks, on, "n", cfg.hot_key_rows)
    return (
        spread_join(shown, below, on, hot, "author_id", written=save is not unsaved and subfield is None)
        .select(
            "subfield_1",
            "author_id",
            "ws_cite_ratio",
            ratio("_position", "n_group").alias("ratio_position"),
            "ws_nc",
            "ws_nc_citing",
            "top_listed",
        )
    )
