"""A training corpus from raw documents: five stages, each an operator, each written before the next.

Every stage gets the rows that the one before kept and returns the columns of documents; the
last returns the packed pieces. Each result is written as Parquet below the folder in
spark.checkpoint.dir, so that a lost executor costs at most the stage it was working on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import decontaminate, near_dedup, packing, secrets, toxicity
from laurel.llm.tables import DOCUMENTS, shared_folder, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar calls toxic go; it learns from the labels of the given documents."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.kept(docs.select(*DOCUMENTS), model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays, once."""
    return near_dedup.kept(docs.select(*DOCUMENTS))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.kept(docs.select(*DOCUMENTS), table(spark, sf_dir, "benchmark"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets that look live are replaced by a mark, n_chars follows."""
    return secrets.redacted(docs.select(*DOCUMENTS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: SQL can express neither the toxicity model nor packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
