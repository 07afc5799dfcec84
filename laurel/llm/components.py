"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.tables import settled


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Ties each node's neighbours to its least neighbour: the larger ones, or the smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = both.join(least, "a")
    if large:
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).filter("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    hangs = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    holds = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = hangs.unionByName(holds).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of the links (a, b); the component is its least node.

    Every round is written to the shared checkpoint folder. The rounds end when each
    component is a star around its least node: no node then hangs on two others, or on one
    while others hang on it.
    """
    edges = settled(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
                    .filter("a != b").distinct())
    while not _are_stars(edges):
        edges = settled(_stars(_stars(edges, large=True), large=False))
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
