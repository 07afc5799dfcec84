"""A complete run from Parquet inputs to CSV reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from laurel.config import MetricConfig
from laurel.plans.pipeline import Inputs, Pipeline
from laurel.sources import readers


def load_inputs(
    spark: SparkSession,
    publications: str,
    institutions: str,
    paper_subfields: str,
    labels: str,
    discontinued: str | Iterable[int] | None = None,
    year_column: str = "year",
) -> Inputs:
    """The five inputs from their paths; ``discontinued`` is a path, ids, or nothing."""
    named = readers.read_labels(spark, labels)
    if discontinued is None or isinstance(discontinued, str):
        listed = readers.read_discontinued(spark, discontinued)
    else:
        listed = readers.discontinued_from_ids(spark, discontinued)
    return Inputs(
        publications=readers.read_publications(spark, publications, year_column),
        institutions=readers.read_institutions(spark, institutions),
        classification=readers.read_classification(spark, paper_subfields, named),
        labels=named,
        discontinued=listed,
    )


def run(
    spark: SparkSession, inputs: Inputs, cfg: MetricConfig, stages: str, output: str, version: str
) -> dict[str, str]:
    """Check the inputs, build every stage below ``stages``, write the reports to ``output``.

    ``version`` identifies the input snapshot; a new one never reuses old stages.
    """
    pipeline = Pipeline(spark, inputs, cfg, stages, version)
    pipeline.check_inputs()
    return pipeline.write_reports(output)
