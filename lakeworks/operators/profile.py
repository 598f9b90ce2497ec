"""Profiles of a table and its schema, each in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def profile_nulls(df: DataFrame) -> DataFrame:
    """Nulls per column, with the row and column counts of the table."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)]
    per_column = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_count"))
        for i, c in enumerate(df.columns)
    ]
    return (
        df.agg(F.count(F.lit(1)).alias("row_count"), *counts)
        .select("row_count", F.explode(F.array(*per_column)).alias("p"))
        .select("p.column_name", "p.null_count", "row_count", F.lit(len(df.columns)).alias("column_count"))
    )


def schema_findings(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns that are missing, extra, or of another type than expected.

    ``rows`` says how much each finding matters: all rows for a missing column, the rows that
    hold a value for an extra one, and the rows whose value the expected type cannot take for
    a type mismatch. Only a missing column makes the schema fail.
    """
    actual = dict(df.dtypes)
    found = {}
    for name in sorted(set(expected) | set(actual)):
        if name not in actual:
            found[name] = ("missing", F.count(F.lit(1)))
        elif name not in expected:
            found[name] = ("extra", F.count(F.col(name)))
        elif actual[name] != expected[name]:
            lost = F.col(name).isNotNull() & F.col(name).try_cast(expected[name]).isNull()
            found[name] = ("type_mismatch", F.count_if(lost))
    if not found:
        schema = "column_name string, finding string, rows bigint, passed boolean"
        return df.sparkSession.createDataFrame([], schema)
    counts = [rows.alias(f"c{i}") for i, (_, rows) in enumerate(found.values())]
    lines = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("finding"),
            F.col(f"c{i}").alias("rows"),
            F.lit(kind != "missing").alias("passed"),
        )
        for i, (name, (kind, _)) in enumerate(found.items())
    ]
    return df.agg(*counts).select(F.explode(F.array(*lines)).alias("f")).select("f.*")
