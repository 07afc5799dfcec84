"""CSV reports: write, read back, and turn text into typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The same options on both sides, or quoted text does not survive.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def write_report(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a CSV report and keep the row order of a sorted frame.

    A sorted frame becomes part files whose names follow the order. Use
    ``single_file`` for reports bounded by the subject list or smaller; a top
    list grows with the authors and should stay in parts.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a report back; reports are text, so the schema is usually ``text_schema``."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def typed_report(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Turn report text into numbers.

    ``kinds`` maps columns to ``int``, ``rawint`` (an integer shown without
    grouping), ``dec``, ``perc`` (``"12.34 %"`` -> 0.1234) or ``perc_r`` (already
    a fraction); other columns pass through. Unreadable text becomes NULL.
    """

    def typed(name: str):
        column = F.col(f"`{name}`").cast("string")
        kind = kinds.get(name)
        if kind in ("int", "rawint"):
            return column.try_cast("double").try_cast("long").alias(name)
        if kind in ("dec", "perc_r"):
            return column.try_cast("double").alias(name)
        if kind == "perc":
            number = F.trim(F.regexp_replace(column, "%", "")).try_cast("double")
            return (number / 100).alias(name)
        if kind is not None:
            raise ValueError(f"unknown kind {kind!r} for column {name!r}")
        return F.col(f"`{name}`")

    return df.select(*[typed(c) for c in df.columns])


def printed_report(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text of every cell, with NULL as ``N/A`` in percent columns and blank in numbers."""

    def printed(name: str):
        text = F.col(f"`{name}`").cast("string")
        kind = kinds.get(name)
        if kind is None:
            return text.alias(name)
        return F.coalesce(text, F.lit("N/A" if kind == "perc" else "")).alias(name)

    return df.select(*[printed(c) for c in df.columns])
