"""Keeping a set of snapshot or Iceberg tables in shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lakeworks.operators.files import TARGET_FILE_BYTES, file_stats, maintenance_plan
from lakeworks.sources.iceberg import IcebergTable
from lakeworks.sources.snapshots import SnapshotTable

Table = SnapshotTable | IcebergTable


def analyze(
    spark: SparkSession,
    tables: Mapping[str, Table],
    policy: str = "intelligent",
    force: bool = False,
    sort_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per table: its files, priority, and what the policy would do."""
    listings = [t.files(spark, name) for name, t in tables.items()]
    stats = file_stats(reduce(DataFrame.unionAll, listings))
    return maintenance_plan(stats, policy, force, sort_columns)


def maintain(
    spark: SparkSession,
    tables: Mapping[str, Table],
    policy: str = "intelligent",
    force: bool = False,
    sort_columns: Sequence[str] = (),
    retain_last: int = 30,
    target_bytes: int = TARGET_FILE_BYTES,
    zorder: bool = False,
) -> list[dict]:
    """Do what ``analyze`` plans, table by table; returns the plan rows that were followed."""
    plan = analyze(spark, tables, policy, force, sort_columns).orderBy("table").collect()
    for row in plan:
        t = tables[row["table"]]
        if row["rewrite"] == "compact":
            t.compact(spark, target_bytes)
        elif row["rewrite"] == "sort":
            t.rewrite_sorted(spark, sort_columns, target_bytes, zorder=zorder)
        if row["expire_snapshots"]:
            t.expire_snapshots(spark, retain_last)
    return [r.asDict() for r in plan]
