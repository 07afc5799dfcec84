"""Exact descending ranks of numbers in groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.spread import running_totals

# Cells are 2**-24 wide and 2**14 of them form a block. Both are plain
# functions of the value, so they do not depend on the data or its layout.
CELL_BITS = 24
BLOCK_BITS = 14


def cell_of(value: Column) -> Column:
    """Fixed-point number that never decreases as the value grows.

    Declared non-NULL: a nullable join key would get an extra filter in one branch
    of the plan, and the branches could no longer share their shuffles.
    """
    return F.coalesce(
        F.floor(value * F.lit(float(1 << CELL_BITS))).cast("long"), F.lit(0).cast("long")
    )


def value_ranks(
    rows: DataFrame, by: Sequence[str], value: str, blocks: bool = True, times: str | None = None
) -> DataFrame:
    """One row per distinct (``by``, ``value``): its count and how many rows lie above it.

    ``value`` must be a non-NULL double and so must the ``by`` columns be. Equal
    values collapse in the map-side part of the first aggregation, so a tie shared
    by any number of rows costs one row here. The rest is ordered block, cell,
    value: see ``running_totals``. ``blocks=False`` leaves out the coarsest level
    when ``by`` already confines the values to a narrow interval. ``times`` names a
    column that says how many rows a row stands for.
    Columns added: ``n``, ``n_before`` (rows with a greater value), ``n_group``.
    """
    by = list(by)
    values = (
        rows.groupBy(*by, value)
        .agg((F.sum(times) if times else F.count(F.lit(1))).alias("n"))
        .withColumn("_fine", cell_of(F.col(value)))
    )
    levels = [("_fine", "desc"), (value, "desc")]
    if blocks:
        values = values.withColumn("_block", F.shiftright("_fine", BLOCK_BITS))
        levels = [("_block", "desc"), *levels]
    return running_totals(values, by, levels, ["n"]).drop("_fine", "_block")


def positions(
    df: DataFrame,
    order: Sequence[Column | str],
    save: Callable[[str, DataFrame], DataFrame],
    stage: str,
) -> DataFrame:
    """``df`` with ``position``, from 1: the place of each row in a total order.

    One range exchange sorts the rows; each task numbers its own, and the sizes of the
    tasks before it are added. The one window without a key covers a row per task, never the
    rows. ``order`` should leave no ties, so that no task gets more than its share and the
    places are definite. ``save`` has to write its frame, as ``stage``, and read it back: a
    second sort could draw other borders.
    """
    task = F.shiftright("_at", 33)
    placed = save(stage, df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_task", task)
        .join(F.broadcast(starts), "_task")  # a row per task
        .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + local + 1).alias("position"))
    )
