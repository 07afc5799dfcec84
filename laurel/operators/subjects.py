"""Subject volumes, subject ranking per author, main subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laurel.config import MetricConfig
from laurel.functions.columns import ratio, sum_if


LEVELS = ("subfield", "field")


def subject_counts(rows: DataFrame, cfg: MetricConfig) -> DataFrame:
    """Rows per (author, subfield, field) of the authors with enough core papers.

    ``n_kept`` counts those inside the optional overall lower year. However many
    papers an author has, at most one row per subject remains, which is what
    every later step of the subject assignment works on.
    """
    kept = F.lit(True)
    if cfg.overall_min_year is not None:
        kept = F.col("year") >= cfg.overall_min_year
    counted = rows.groupBy("auid", "subfield", "field").agg(
        F.count(F.lit(1)).alias("n"),
        sum_if(F.col("is_core")).alias("n_core"),
        sum_if(kept).alias("n_kept"),
    )
    # a window over at most one row per subject and author
    core = F.sum("n_core").over(Window.partitionBy("auid"))
    return counted.withColumn("_core", core).filter(F.col("_core") >= cfg.min_core_papers).drop(
        "_core"
    )


def _by_level(counts: DataFrame) -> DataFrame:
    """Each count row once per level, as (level, subject)."""
    entries = [
        F.struct(F.lit(level).alias("level"), F.col(level).alias("subject")) for level in LEVELS
    ]
    return counts.select(
        "auid",
        "n",
        "n_kept",
        F.when(F.col("field").isNotNull(), F.col("n")).otherwise(0).alias("n_with_field"),
        F.explode(F.array(*entries)).alias("_e"),
    ).select("auid", "n", "n_kept", "n_with_field", "_e.level", "_e.subject")


def subject_volumes(counts: DataFrame) -> DataFrame:
    """Author-on-paper rows per level and subject over all profiled authors.

    Rows without a subject form a group of their own.
    """
    return _by_level(counts).groupBy("level", "subject").agg(F.sum("n").alias("n_overall"))


def rank_subjects(counts: DataFrame, volumes: DataFrame) -> DataFrame:
    """Each author's ``subfields`` and ``fields`` as arrays in rank order, unclassified last.

    Order: more papers first, then the overall rarer subject, then the name.
    Fractions of both levels share one denominator: papers of any type with a field.
    ``volumes`` has one row per subject label, and the arrays are no longer than
    that. Subjects without a paper inside the overall lower year take part in the
    ranking but are not listed.
    """
    # NULL gets its own key so that both sides join as plain equality
    missing = F.col("subject").isNull()
    key = F.when(missing, F.lit("")).otherwise(F.concat(F.lit("="), F.col("subject")))
    per_subject = (
        _by_level(counts)
        .groupBy("auid", "level", "subject")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_kept", "n_with_field")])
        .withColumn("_key", key)
        .join(volumes.select("level", key.alias("_key"), "n_overall"), ["level", "_key"])
    )
    entry = F.struct(
        missing.alias("last"),
        (-F.col("n")).alias("minus_n"),
        "n_overall",
        "subject",
        "n_kept",
    )
    listed = per_subject.groupBy("auid").agg(
        # every row counts once per level, so one level alone gives the author's total
        sum_if(F.col("level") == LEVELS[0], F.col("n_with_field")).alias("_classified"),
        *[
            F.array_sort(F.collect_list(F.when(F.col("level") == level, entry))).alias(f"{level}s")
            for level in LEVELS
        ],
    )

    def ranked(level: str):
        numbered = F.transform(
            f"{level}s",
            lambda s, i: F.struct(
                (i + 1).alias("rank"),
                s["subject"].alias("subject"),
                (-s["minus_n"]).alias("n_author"),
                s["n_overall"].alias("n_overall"),
                F.col("_classified").alias("n_classified"),
                ratio(-s["minus_n"], F.col("_classified")).alias("fraction"),
                s["n_kept"].alias("n_kept"),
            ),
        )
        present = F.filter(numbered, lambda s: s["n_kept"] > 0)
        return F.transform(present, lambda s: s.dropFields("n_kept")).alias(f"{level}s")

    return listed.select("auid", *[ranked(level) for level in LEVELS]).filter(
        F.size(f"{LEVELS[0]}s") > 0
    )


def top_subjects(profile: DataFrame) -> DataFrame:
    """First and second subfield and first field with their fractions."""

    def pick(array: str, index: int, part: str):
        entry = F.get(F.col(array), F.lit(index))
        return F.when(entry["n_classified"] >= 1, entry[part])

    return profile.withColumns({
        "subfield_1": pick("subfields", 0, "subject"),
        "subfield_1_frac": pick("subfields", 0, "fraction"),
        "subfield_2": pick("subfields", 1, "subject"),
        "subfield_2_frac": pick("subfields", 1, "fraction"),
        "field_1": pick("fields", 0, "subject"),
        "field_1_frac": pick("fields", 0, "fraction"),
    })
