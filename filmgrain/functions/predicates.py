"""Filters as Column predicates in forms that reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(parts: list[Column]) -> Column | None:
    """The conjunction, or None where there is nothing to filter."""
    return reduce(lambda a, b: a & b, parts) if parts else None


def payload_filter(min_year: int | None = None, max_year: int | None = None, min_rating: float | None = None) -> Column | None:
    parts: list[Column] = []
    if min_year:
        parts.append(F.col("year") >= min_year)
    if max_year:
        parts.append(F.col("year") <= max_year)
    if min_rating:
        parts.append(F.col("rating") >= min_rating)
    return all_of(parts)


def in_year(date: Column, year: int) -> Column:
    """A range on the date itself; year(date) = y would not be pushed down."""
    return (date >= F.lit(f"{year}-01-01").cast("date")) & (date < F.lit(f"{year + 1}-01-01").cast("date"))


def any_genre(names: Column, wanted: tuple[str, ...]) -> Column:
    """Exact, case-sensitive; NULL arrays and NULLs inside never match."""
    return F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, wanted))), F.lit(False))
