"""Run checks: key uniqueness and author counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once with their row count; expected to be empty."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """Return ``df`` unchanged, or fail if a key repeats."""
    if not repeated_keys(df, *key).isEmpty():
        raise ValueError(f"key {key} repeats")
    return df


def uniqueness_check(df: DataFrame, *key: str) -> DataFrame:
    """One row: rows in total and rows whose key repeats."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias(
            "n_repeated_rows"
        ),
    )


def run_summary(ranked: DataFrame) -> DataFrame:
    """Authors in the table and authors with a field."""
    return ranked.agg(
        F.count(F.lit(1)).alias("n_authors"), F.count("field_1").alias("n_authors_with_field")
    )
