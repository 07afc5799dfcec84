"""Parquet inputs with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laurel import schemas


def dataset_path(base: str, version: str, extent: str, table: str) -> str:
    """Path of one table in a versioned data folder (``extent``: sample or full)."""
    return "/".join(part.strip("/") if i else part.rstrip("/") for i, part in enumerate(
        (base, version, extent, table)
    ))


def read_publications(
    spark: SparkSession, path: str, year_column: str = "year", table: str | None = None
) -> DataFrame:
    """Publications; ``year_column`` names the year the run sorts and filters by.

    ``path`` may be a plain folder or one divided by year (``write_publications``), of which
    filters on the year read the folders they need. ``table`` names a catalog table over the same
    files: if it lies in buckets by paper, joins by paper read it without an exchange.
    """
    schema = schemas.PUBLICATIONS
    if year_column not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField(year_column, T.IntegerType())])
    if table is not None:
        return spark.table(table).select(*schema.names)
    return spark.read.schema(schema).parquet(path)


def write_publications(
    publications: DataFrame, path: str, year_column: str = "year", rows_per_file: int = 1_000_000
) -> None:
    """Publications in a folder for each year, as ``read_publications`` takes them.

    A run then lists and reads only the years it asks for. A year's papers are dealt by id
    over as many files as ``rows_per_file`` calls for, so that neither a year that holds most
    papers goes through one task nor a small one makes a file per task. Papers without a
    year have a folder of their own.
    """
    years = publications.groupBy(F.col(year_column).alias("_year")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).cast("int").alias("_files")
    )
    (
        publications.join(F.broadcast(years), F.col(year_column).eqNullSafe(F.col("_year")))  # a row per year
        .withColumn("_file", F.pmod(F.xxhash64("eid"), F.col("_files")))
        .repartition("_year", "_file")
        .drop("_year", "_files", "_file")
        .write.mode("overwrite").partitionBy(year_column).parquet(path)
    )


def read_institutions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INSTITUTIONS).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).parquet(path)


def read_classification(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """Subfield rows of papers, resolved to domain, field and subfield."""
    return resolve_labels(spark.read.schema(schemas.PAPER_SUBFIELD).parquet(path), labels)


def resolve_labels(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Match subfield names without regard to case and outer blanks; unknown ones drop."""
    named = labels.withColumn("_match", F.lower(F.trim("subfield")))
    return (
        raw.withColumn("_match", F.lower(F.trim("subfield_hybrid")))
        .join(named, "_match")
        .select("eid", "domain", "field", "subfield")
    )


def read_discontinued(spark: SparkSession, path: str | None) -> DataFrame:
    """Ids of discontinued sources; ``None`` is an empty list."""
    if path is None:
        return spark.createDataFrame([], schemas.DISCONTINUED)
    return spark.read.schema(schemas.DISCONTINUED).parquet(path)


def discontinued_from_ids(spark: SparkSession, ids) -> DataFrame:
    """The same dimension from ids held in Python, as a run script may list them."""
    return spark.createDataFrame([(int(i),) for i in (ids or [])], schemas.DISCONTINUED)
