"""Labelled rows to learn from: which, and how many at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import text_of

SAMPLE = 20_000


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `modulus`; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, sample: int = SAMPLE) -> DataFrame:
    """(text as bytes, label 0.0 or 1.0, fold 0..9) of the labelled documents to learn from.

    Held-out ids are left out first. Of the others the `sample` ids with the least
    fingerprints are taken, a bound that lets them be broadcast. An id with several labels
    counts with the greatest, rows without id or label do not count. The fold follows the id.
    """
    use = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(modulus) != held_out))
    use = use.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("double").alias("_label"))
    use = use.orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text"))
    rows = rows.join(F.broadcast(use), "_id")
    return rows.select("text", F.col("_label").alias("label"), F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(10)).alias("fold"))
