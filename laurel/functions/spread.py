"""Joins and running totals that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laurel.functions.bloom import packed_words, word_at

# As many keys of a written list are broadcast, and no more; see ``spread_join`` and ``list_join``.
# Such lists grow with the rows, and the driver holds what is broadcast.
MOST_LISTED = 1 << 14

# Cells of a byte, eight in a word of the table of the other keys: four or more for each key, 16 MB at most.
CELLS_PER_KEY = 4
LEAST_CELLS, MOST_CELLS = 1 << 12, 1 << 24


def hot_keys(counts: DataFrame, on: Sequence[str], n: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and the number of slices each needs.

    ``counts`` has one row per key, so the result has at most ``total rows / limit`` rows.
    """
    return counts.filter(F.col(n) > limit).select(
        *on, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_slices")
    )


def any_of(hot: DataFrame) -> DataFrame | None:
    """A written list of hot keys, or None if it is empty: then a join needs no slices.

    A join cut into slices exchanges both sides, even where they lie in buckets by its key.
    """
    return None if hot.isEmpty() else hot


def list_join(rows: DataFrame, hot: DataFrame, key: str, how: str) -> DataFrame:
    """The rows whose key is in a list of hot keys (``left_semi``) or is not (``left_anti``).

    A long list is merged: with both sides in buckets by the key nothing is exchanged. The list
    is counted, so it should be written.
    """
    ids = hot.select(key)
    return rows.join(F.broadcast(ids) if hot.count() <= MOST_LISTED else ids.hint("merge"), key, how)


def _power() -> Column:
    """The least power of two that reaches the slices of a hot key: at least 1."""
    return F.length(F.bin(F.col("_slices").cast("long") - 1)).cast("int")


def hottest(hot: DataFrame) -> tuple[int, int]:
    """How many hot keys there are, and the power up to which they are too many to be broadcast."""
    powers = hot.groupBy(_power().alias("power")).count().orderBy(F.desc("power")).collect()  # 31 rows at most
    kept = 0
    for power, n in powers:
        kept += n
        if kept > MOST_LISTED:
            return sum(n for _, n in powers), power
    return kept, 0


def _cells(keys: Sequence[Column], n_cells: int) -> tuple[Column, list[Column]]:
    """The word of a key and the places of its two cells there, from separate parts of one hash."""
    hashed = F.xxhash64(*keys)
    first, step = (F.pmod(F.shiftright(hashed, low), F.lit(m)) for low, m in ((40, 8), (46, 7)))
    places = [first, F.pmod(first + step + 1, F.lit(8))]
    return hashed.bitwiseAND(F.lit(n_cells // 8 - 1)), [F.shiftleft(p.cast("int"), 3) for p in places]


def slice_cells(hot: DataFrame, on: Sequence[str], n_keys: int) -> tuple[DataFrame, int]:
    """A list of hot keys as one row of ``words``, whatever its length, and the number of cells.

    A key marks its two cells with its power of two; a cell keeps the greatest. So the lesser of
    its cells is at least what a key needs, and 0 for six of seven other keys or more, as long as
    the list has no more than four million.
    """
    n_cells = min(max(LEAST_CELLS, 1 << (CELLS_PER_KEY * n_keys - 1).bit_length()), MOST_CELLS)
    word, places = _cells([F.col(k) for k in on], n_cells)
    marked = hot.select(word.alias("word"), F.explode(F.array(*places)).alias("place"), _power().alias("power"))
    words = marked.groupBy("word", "place").agg(F.max("power").cast("long").alias("power")).select(
        "word", F.call_function("shiftleft", F.col("power"), F.col("place")).alias("bits")
    )
    return packed_words(words, n_cells // 8), n_cells


def slices_by_cell(rows: DataFrame, cells: DataFrame, n_cells: int, keys: Sequence[Column]) -> DataFrame:
    """``rows`` with ``_by_cell``, the slices of their key by ``slice_cells``: as many as it needs, or more."""
    word, places = _cells(keys, n_cells)
    rows = rows.withColumn("_word", word_at(cells.select("words").scalar(), word))  # one copy of the words
    powers = [
        F.call_function("shiftright", F.col("_word"), p).bitwiseAND(F.lit(255)) for p in places
    ]
    return rows.withColumn(
        "_by_cell", F.call_function("shiftleft", F.lit(1), F.least(*powers).cast("int"))
    ).drop("_word")


# Rows without a key match nothing; a left join deals them out over this many slices.
NULL_KEY_SLICES = 1024


def _with_slices(
    side: DataFrame, listed: DataFrame, on: Sequence[str], others: Column | None = None
) -> DataFrame:
    """``side`` with ``_slices``: those of a listed key, ``others`` or one for the rest."""
    rest = F.lit(1) if others is None else others
    return side.join(F.broadcast(listed), list(on), "left").withColumn("_slices", F.coalesce("_slices", rest))


def spread_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    hot: DataFrame | None,
    spread_by: Column | str,
    how: str = "inner",
    written: bool = False,
) -> DataFrame:
    """Inner or left equi-join in which each hot key of ``many`` is cut into slices.

    Rows of ``many`` with a hot key get a slice number from ``spread_by``; the
    matching rows of ``one`` are repeated once per slice. Every pair is still
    produced exactly once. Without hot keys this is a plain join. A list that is ``written``
    is read first to see how long it is. Of a long one the hottest keys are broadcast; the
    others travel as a table of bounded size, by which some keys have more slices than they
    need, on both sides alike. Any other list is broadcast: its limit has to keep it short.
    """
    on = list(on)
    if hot is None:
        return many.join(one, on, how)
    n_keys, power = hottest(hot) if written else (0, 0)
    if power == 0:
        many, one = (_with_slices(side, hot, on) for side in (many, one))
    else:
        cells = slice_cells(hot.filter(_power() <= power), on, n_keys)
        # equal keys of different types would have different hashes
        keys = [F.col(k).cast(hot.schema[k].dataType) for k in on]
        listed = hot.filter(_power() > power)
        many, one = (
            _with_slices(slices_by_cell(side, *cells, keys), listed, on, F.col("_by_cell")).drop("_by_cell")
            for side in (many, one)
        )
    dealt = F.xxhash64(spread_by)
    slice_of = F.pmod(dealt, F.col("_slices"))
    if how == "left":
        keyless = F.lit(False)
        for key in on:
            keyless = keyless | F.col(key).isNull()
        slice_of = F.when(keyless, F.pmod(dealt, F.lit(NULL_KEY_SLICES))).otherwise(slice_of)
    many = many.withColumn("_slice", slice_of.cast("int")).drop("_slices")
    one = one.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    ).drop("_slices")
    if power:  # Spark's estimate does not see the repeats, and might broadcast them
        one = one.hint("merge")
    return many.join(one, [*on, "_slice"], how).drop("_slice")


def running_totals(
    cells: DataFrame,
    by: Sequence[str],
    levels: Sequence[tuple[str, str]],
    amounts: Sequence[str],
    keep: Column | None = None,
) -> DataFrame:
    """Exclusive running sums over a lexicographic order, without one window per group.

    ``cells`` has one row per ``by`` + level columns. The levels go from the
    coarsest to the finest, each with ``"asc"`` or ``"desc"``; together they
    define the order inside ``by``. Sums are taken level by level: a window only
    ever covers the children of one parent, so its size is the fan-out of a
    level and not the size of the group. Adds ``<amount>_before`` for each amount
    plus ``<amount>_group``, the total of the group. ``keep`` tells from the sums of the
    coarsest level which of its cells are ordered further; the others are left out.
    """
    by = list(by)
    names = [name for name, _ in levels]
    frames = {len(names): cells}
    for depth in range(len(names) - 1, 0, -1):
        frames[depth] = frames[depth + 1].groupBy(*by, *names[:depth]).agg(
            *[F.sum(a).alias(a) for a in amounts]
        )

    above = None
    for depth, (name, direction) in enumerate(levels, start=1):
        parent = [*by, *names[: depth - 1]]
        order = F.col(name).desc() if direction == "desc" else F.col(name).asc()
        siblings = Window.partitionBy(*parent)
        earlier = siblings.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        level = frames[depth] if above is None else frames[depth].join(above, parent)
        for a in amounts:
            before = F.coalesce(F.sum(a).over(earlier), F.col(a) - F.col(a))
            if above is None:
                level = level.withColumn(f"{a}_before", before)
                level = level.withColumn(f"{a}_group", F.sum(a).over(siblings))
            else:
                level = level.withColumn(f"{a}_before", F.col(f"_{a}_base") + before)
                level = level.drop(f"_{a}_base")
        if above is None and keep is not None:
            level = level.filter(keep)
        if depth < len(names):
            above = level.select(
                *parent,
                name,
                *[f"{a}_group" for a in amounts],
                *[F.col(f"{a}_before").alias(f"_{a}_base") for a in amounts],
            )
    return level
