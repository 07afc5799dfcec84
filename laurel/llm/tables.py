"""What the operators share about tables: reading, ids, shared folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text as UTF-8 bytes; a missing text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def id_of(column: str = "doc_id") -> Column:
    """The id as a long; rows without an id come before all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_back(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local session without that setting, as in tests, gets one of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: lineage ends here."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
