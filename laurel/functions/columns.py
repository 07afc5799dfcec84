"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: author ids up to this one are placeholders, not people.
LAST_PLACEHOLDER_AUTHOR = 4


def in_collections(collections: Column | str, names: Iterable[str]) -> Column:
    """True when the paper sits in one of the named collections (NULL stays NULL)."""
    return F.arrays_overlap(collections, F.array(*[F.lit(n) for n in names]))


def author_id(raw: Column) -> Column:
    """Author id as a long; text that is no number becomes NULL instead of failing."""
    return raw.try_cast("long")


def author_slots() -> Column:
    """Author ids and positions of a paper as one array of structs.

    Built from the two fields, not from the record: a scan then reads those two
    columns and leaves the name columns, the bulk of an author list, on disk.
    """
    return F.arrays_zip(F.col("Au.auid").alias("auid"), F.col("Au.Authorseq").alias("Authorseq"))


def is_person(auid: Column) -> Column:
    return auid.isNotNull() & (auid > LAST_PLACEHOLDER_AUTHOR)


def display_name(author: Column) -> Column:
    """``surname, given`` (or initials), else the preferred index name, else the index name."""
    given = F.coalesce(author["given_name_pn"], author["initials_pn"])
    return F.coalesce(
        F.concat(author["surname_pn"], F.lit(", "), given),
        author["indexed_name_pn"],
        author["indexed_name"],
    )


def percent(share: Column, unit: str = "%") -> Column:
    """0.1234 -> ``12.34%``; pass ``" %"`` for the spaced form."""
    return F.concat(F.round(share * 100, 2).cast("string"), F.lit(unit))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Floating division that is NULL on a zero denominator."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return F.try_divide(num.cast("double"), den.cast("double"))


def sum_if(condition: Column, value: Column | int = 1) -> Column:
    """Sum of ``value`` over the rows that satisfy ``condition``; 0 when there are none."""
    amount = value if isinstance(value, Column) else F.lit(value).cast("long")
    return F.sum(F.when(condition, amount).otherwise(F.lit(0).cast("long")))
