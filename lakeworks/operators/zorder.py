"""Order by several columns at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.functions.columns import by_bounds

RANK_BITS = 7
PREFIX_BYTES = 6


def with_zorder(df: DataFrame, columns: Sequence[str], name: str = "_z", bits: int = RANK_BITS) -> DataFrame:
    """The rows with a long whose order keeps rows near that are near in all of the columns.

    Each column is ranked into ``2 ** bits`` parts of about equal size (one aggregate finds their
    bounds), and the bits of the ranks are interleaved, the first column's in the highest place.
    Nulls rank lowest. Numbers, times, booleans and text (by its first ``PREFIX_BYTES`` bytes) have a rank.
    """
    if not columns or bits * len(columns) > 62:
        raise ValueError(f"between 1 and {62 // bits} columns can be interleaved")
    numbers = {c: _number(df, c) for c in columns}
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = df.agg(*[F.percentile_approx(n, shares, 10000).alias(c) for c, n in numbers.items()]).first()
    ranks = [f"{name}_{i}" for i in range(len(columns))]
    df = df.withColumns({r: _rank(n, bounds[c]) for r, (c, n) in zip(ranks, numbers.items())})
    places = [
        F.shiftleft(F.shiftright(r, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(ranks) + len(ranks) - 1 - i)
        for i, r in enumerate(ranks)
        for bit in range(bits)
    ]
    return df.withColumn(name, reduce(Column.bitwiseOR, places)).drop(*ranks)


def _rank(number: Column, bounds: Sequence[float] | None) -> Column:
    if not bounds:
        return F.lit(0)
    return F.when(number.isNotNull(), by_bounds(number, bounds, list(range(len(bounds) + 1)))).otherwise(F.lit(0))


def _number(df: DataFrame, column: str) -> Column:
    """A double in the order of the column."""
    kind, col = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):
        digits = F.hex(F.substring(F.encode(col, "UTF-8"), 1, PREFIX_BYTES))
        return F.conv(F.rpad(digits, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")
    raise ValueError(f"{column}: {kind.simpleString()} cannot be interleaved")
