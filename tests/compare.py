"""Compare a Spark result with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duckdb_over(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.12g}")
    return float(value) if isinstance(value, int) else str(value)


def rows_by_name(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty when both hold the same rows under the same column names."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    if sorted(expected_columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(expected_columns)}"
    expected = rows_by_name(expected_columns, result.fetchall())
    actual = rows_by_name(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if actual == expected:
        return ""
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"extra {list(extra)[:2]}, missing {list(missing)[:2]}"
    )
