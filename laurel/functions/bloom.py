"""A Bloom filter over ids, made and asked with column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ID = 8
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 28
ROW_WORDS = 64


def filter_bits(n_ids: int) -> int:
    """Bits for so many ids: a power of two, eight or more bits an id, 32 MB at most.

    An id sets three bits of one word of 64. Of ids that are not in the filter 4 % pass at
    eight bits an id, which holds up to 33 million ids; 15 % at 67 million; 31 % at 100 million.
    """
    return min(max(LEAST_BITS, 1 << (BITS_PER_ID * n_ids - 1).bit_length()), MOST_BITS)


def _word_and_mask(value: Column, bits: int) -> tuple[Column, Column]:
    """The word of an id and its three bits there, from separate parts of one hash."""
    hashed = F.xxhash64(value)
    places = [F.shiftright(hashed, low).bitwiseAND(F.lit(63)).cast("int") for low in (40, 46, 52)]
    one, other, third = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    return hashed.bitwiseAND(F.lit(bits // 64 - 1)), one.bitwiseOR(other).bitwiseOR(third)


def bloom_filter(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with the filter over ``ids[column]`` as rows of words, ``array<array<long>>``.

    One pass, combined on the map side; the words are put together in rows of 64 before
    they meet, so that the last task handles bits / 4096 small arrays. A row an id travels at most.
    """
    word, mask = _word_and_mask(F.col(column), bits)
    return packed_words(ids.select(word.alias("word"), mask.alias("bits")), bits // 64)


def packed_words(set_bits: DataFrame, n_words: int) -> DataFrame:
    """One row with all ``n_words`` words in rows of 64, from rows of ``word`` and ``bits`` to set in it."""
    none = set_bits.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    rows = words.groupBy(F.expr(f"word div {ROW_WORDS}").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")
    )
    ordered = F.array_sort(F.collect_list(F.struct("row", F.transform("words", lambda w: w["bits"]).alias("bits"))))
    return rows.agg(F.transform(ordered, lambda r: r["bits"]).alias("words"))


def might_hold(words: Column, bits: int, value: Column) -> Column:
    """False only for values that are not in the filter."""
    word, mask = _word_and_mask(value, bits)
    return word_at(words, word).bitwiseAND(mask) == mask


def word_at(words: Column, word: Column) -> Column:
    row = F.get(words, F.shiftright(word, 6).cast("int"))
    return F.get(row, word.bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int"))


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """One row with ``bits`` and ``words``: a filter over ``ids[column]``, sized by their number."""
    known = ids.select(column).na.drop()
    bits = filter_bits(known.count())
    return bloom_filter(known, column, bits).withColumn("bits", F.lit(bits))


def held(wanted: DataFrame | None, value: Column) -> Column:
    """``might_hold`` by a written ``id_filter``; true for every value without one."""
    if wanted is None:
        return F.lit(True)
    return might_hold(wanted.select("words").scalar(), wanted.select("bits").first()["bits"], value)
