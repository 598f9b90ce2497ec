"""Parsing and normalising columns. Bad input becomes null, also under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_ts(col: Column | str) -> Column:
    """ISO-8601 text (or a timestamp) as a timestamp; null where it cannot be read."""
    return F.try_to_timestamp(as_column(col))


def parse_date(col: Column | str) -> Column:
    """Calendar date of an ISO-8601 text or timestamp; null where it cannot be read."""
    return F.to_date(parse_ts(col))


def money(col: Column | str) -> Column:
    """decimal(18,2), rounded half up; null for text that is no number and on overflow."""
    return as_column(col).try_cast("decimal(18,2)")


def iso_text(col: Column | str) -> Column:
    """Timestamp as ISO-8601 text with seconds and no zone."""
    return F.date_format(as_column(col), ISO_SECONDS)


def by_bounds(col: Column, bounds: Sequence[float], leaves: Sequence) -> Column:
    """The leaf between whose bounds (sorted, one fewer than leaves) a value lies.

    A tree of comparisons: it compiles to a handful of branches per row, where a search in an
    array would call a lambda for every bound.
    """

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(leaves[low])
        middle = (low + high) // 2
        return F.when(col >= F.lit(float(bounds[middle])), search(middle + 1, high)).otherwise(
            search(low, middle)
        )

    return search(0, len(leaves) - 1)
