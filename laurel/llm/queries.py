"""The operators applied to the test tables, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laurel.llm import (
    decontaminate, divergence, html_text, line_dedup, near_dedup, outliers, packing, quality, secrets, spelling, substring_dedup,
    suffix_dedup, toxicity)
from laurel.llm.tables import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(table(spark, sf_dir, "documents"), size=2)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_windows(table(spark, sf_dir, "documents"), keep_text=False)


def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.screened(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_lines(table(spark, sf_dir, "documents"), keep_text=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_suffix_dedup, op3_near_dedup, op4_html_text, op5_secrets, op6_substring_dedup, op7_outliers, op8_decontaminate, op9_toxicity, op10_packing, op11_spelling,
             op12_divergence, op13_line_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_secrets": secrets.oracle(), "op12_divergence": divergence.oracle(), "op13_line_dedup": line_dedup.oracle()}
