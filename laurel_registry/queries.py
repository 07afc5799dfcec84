"""One registered query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel_registry.tables import (
    CONFIG,
    HOT_CONFIG,
    LOWER_YEAR_CONFIG,
    MAX_CITE_CONFIG,
    PREPRINT_CONFIG,
    SINGLE_YEAR_CONFIG,
    STRICT_CONFIG,
    pipeline,
)
from laurel.functions.columns import author_slots
from laurel.operators import authorship, checks, citations, profile, score, subjects, thresholds
from laurel.operators.indices import BASES
from laurel.plans import reports
from laurel.plans.pipeline import Pipeline
from laurel.sources.readers import read_publications, write_publications
from laurel.sources.reports import read_report, text_schema, typed_report, write_report


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns to a fixed number of places, for the comparison by value."""
    return df.select(*[
        F.round(f"`{f.name}`", digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _authorship(p: Pipeline) -> DataFrame:
    slots = p.inputs.publications.select("eid", author_slots().alias("slots"))
    return authorship.explode_authors(slots).select("eid", "auid", "author_seq", "n_authors")


def _counted(p: Pipeline) -> DataFrame:
    return authorship.counted_publications(p.inputs.publications, p.cfg).select(
        "eid", "year", "publication_type"
    )


def _metrics(*columns: str) -> Callable[[Pipeline], DataFrame]:
    return lambda p: p.paper_metrics.select("auid", *columns)


def _per_basis(*names: str) -> list[str]:
    return [f"{b}_{n}" for b in BASES for n in names]


def _subject_ranking(p: Pipeline) -> DataFrame:
    parts = [
        p.author_subjects.select(
            "auid", F.lit(level).alias("level"), F.explode(f"{level}s").alias("_s")
        ).select("auid", "level", "_s.*")
        for level in subjects.LEVELS
    ]
    return parts[0].unionByName(parts[1])


def _main_subjects(p: Pipeline) -> DataFrame:
    return subjects.top_subjects(p.author_subjects).drop("subfields", "fields")


def _scores(p: Pipeline) -> DataFrame:
    return p.scored.select("auid", *_per_basis(*[f"frac_{m}" for m in score.MEASURES], "c"))


def _ratios(p: Pipeline) -> DataFrame:
    return score.ratios(p.author_profile).select(
        "auid", "self_share", "ns_cite_ratio", "ws_cite_ratio"
    )


def _ranked(p: Pipeline) -> DataFrame:
    return p.ranked.drop("subfields", "fields", *_per_basis(
        *[f"{part}_{m}" for part in ("log", "frac") for m in score.MEASURES]
    ))


def _threshold(level: str) -> Callable[[Pipeline], DataFrame]:
    def build(p: Pipeline) -> DataFrame:
        if level == "total":
            return p.thresholds.filter(F.col("level") == "total").drop("level")
        return thresholds.with_total(p.thresholds, level)

    return build


def _uniqueness(p: Pipeline) -> DataFrame:
    return checks.uniqueness_check(p.author_institution, "auid")


def _top_list(p: Pipeline) -> DataFrame:
    return reports.table1_rows(p.ranked, p.cfg).select("author_id")


def _table1_order(p: Pipeline) -> DataFrame:
    return reports.table1_positions(p.ranked, p.cfg, p.save).select("position", "author_id")


def _table2_order(p: Pipeline) -> DataFrame:
    parts = [
        reports.table2_positions(table, subject, p.save).select(
            F.lit(subject).alias("level"), "position", F.col(subject).alias("subject")
        )
        for subject, table in (("Subfield", p.table2_subfield), ("Field", p.table2_field))
    ]
    return parts[0].unionByName(parts[1])


def _typed_table2(p: Pipeline) -> DataFrame:
    return typed_report(p.table2_subfield, reports.table2_kinds(p.table2_subfield.columns))


def _typed_table2_field(p: Pipeline) -> DataFrame:
    return typed_report(p.table2_field, reports.table2_kinds(p.table2_field.columns))


def _typed_table3(p: Pipeline) -> DataFrame:
    return typed_report(p.table3, reports.table3_kinds(p.table3.columns))


def _report_roundtrip(p: Pipeline) -> DataFrame:
    path = f"{p.store.root}/reports/{p.cfg.artifact_name('Table_1_Authors')}"
    write_report(p.table1, path)
    back = read_report(p.spark, path, text_schema(p.table1.columns))
    return typed_report(back, {**reports.table1_kinds(p.cfg), "author_id": "rawint"})


def _stage_roundtrip(p: Pipeline) -> DataFrame:
    counts = p.save("citation_counts", p.citation_counts)

    def build() -> DataFrame:
        raise RuntimeError("the stage was written and must be read, not built again")

    return p.store.get_or_build("citation_counts", p.cfg, build).select(counts.columns)


def _publications_by_year(p: Pipeline) -> DataFrame:
    path = p.store.path("publications_by_year", p.cfg)
    if not p.store.is_complete(path):
        write_publications(p.inputs.publications, path, p.cfg.year_column)
    divided = read_publications(p.spark, path, p.cfg.year_column)
    return citations.citing_papers(divided, p.cfg).select("eid", "year")


def _distribution(p: Pipeline) -> DataFrame:
    return reports.ratio_distribution(p.ranked, p.cfg, save=p.save)


PLANS: dict[str, Callable[[Pipeline], DataFrame]] = {
    "citation_edges": lambda p: p.edges.select("citing_eid", "cited_eid", "is_discontinued"),
    "self_citations": lambda p: p.edges.filter("is_self = 1").select("citing_eid", "cited_eid"),
    "heavy_references": lambda p: citations.heavy_references(p.inputs.publications, p.cfg, 20),
    "citation_counts": lambda p: p.citation_counts,
    "authorship": _authorship,
    "counted_publications": _counted,
    "publications_by_year": _publications_by_year,
    "author_papers": lambda p: p.author_papers,
    "core_author_filter": lambda p: authorship.core_authors(p.author_papers, p.cfg),
    "paper_counts": _metrics("np", "np_range", *_per_basis("npc", "npc_range")),
    "citation_totals": _metrics(*_per_basis("nc")),
    "distinct_citing": lambda p: p.distinct_citing,
    "h_index": _metrics(*_per_basis("h")),
    "hm_index": _metrics(*_per_basis("hm")),
    "position_metrics": _metrics(*_per_basis("nps", "ncs", "npsf", "ncsf", "npsfl", "ncsfl")),
    "discontinued_counts": _metrics(
        "np_discontinued", "np_range_discontinued", "ws_nc_discontinued"
    ),
    "label_resolution": lambda p: p.inputs.classification,
    "subject_volumes": lambda p: p.subject_volumes,
    "subject_ranking": _subject_ranking,
    "main_subjects": _main_subjects,
    "author_names": lambda p: p.author_names,
    "author_institution": lambda p: p.author_institution,
    "log_maxima": lambda p: p.log_maxima,
    "composite_score": _scores,
    "ratios": _ratios,
    "global_rank": lambda p: p.ranked.select("author_id", *_per_basis("rank")),
    "subfield_rank": lambda p: p.ranked.select(
        "author_id", *_per_basis("subfield_rank"), "subfield_count"
    ),
    "ranked_authors": _ranked,
    "top_list": _top_list,
    "thresholds_subfield": _threshold("subfield"),
    "thresholds_field": _threshold("field"),
    "thresholds_total": _threshold("total"),
    "table1": lambda p: p.table1,
    "table2_subfield": lambda p: p.table2_subfield,
    "table2_field": lambda p: p.table2_field,
    "table3": lambda p: p.table3,
    "table1_order": _table1_order,
    "table2_order": _table2_order,
    "typed_report": _typed_table2,
    "typed_table2_field": _typed_table2_field,
    "typed_table3": _typed_table3,
    "read_institutions": lambda p: p.inputs.institutions,
    "read_labels": lambda p: p.inputs.labels,
    "read_discontinued": lambda p: p.inputs.discontinued,
    "dataset_stats": lambda p: p.dataset_stats,
    "ratio_distribution": _distribution,
    "uniqueness_check": _uniqueness,
    "run_summary": lambda p: p.run_summary,
    "report_roundtrip": _report_roundtrip,
    "stage_roundtrip": _stage_roundtrip,
}


def _lower_year(p: Pipeline) -> DataFrame:
    return p.author_profile.select(
        "auid",
        "np",
        "np_range",
        *_per_basis("nc", "h", "hm", "nps", "ncsfl", "npc", "nc_citing"),
    )


# registered again with hot keys all over
HOT = (
    "citation_edges", "distinct_citing", "h_index", "hm_index", "global_rank", "subfield_rank",
    "author_institution", "thresholds_total", "ratio_distribution",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(plan, cfg):
        return lambda spark, sf_dir: rounded(plan(pipeline(spark, sf_dir, cfg)))

    registered = {name: over(plan, CONFIG) for name, plan in PLANS.items()}
    registered["overall_lower_year"] = over(_lower_year, LOWER_YEAR_CONFIG)
    for name in HOT:
        registered[f"{name}_hot"] = over(PLANS[name], HOT_CONFIG)
    for name in ("table1", "table2_subfield"):
        registered[f"{name}_single_year"] = over(PLANS[name], SINGLE_YEAR_CONFIG)
    registered["strict_self_citations"] = over(PLANS["self_citations"], STRICT_CONFIG)
    registered["max_cite_year"] = over(PLANS["citation_counts"], MAX_CITE_CONFIG)
    registered["with_preprints"] = over(PLANS["paper_counts"], PREPRINT_CONFIG)
    return registered
