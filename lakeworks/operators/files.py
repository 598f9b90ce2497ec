"""What a table's files say about the maintenance it needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_FILE_BYTES = 256 * 1024**2
MEDIUM_FILES = 50
HIGH_FILES = 100


def file_stats(files: DataFrame, by: Sequence[str] = ("table",)) -> DataFrame:
    """Files, bytes and size spread per table (or per table and partition)."""
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("length").alias("total_bytes"),
        F.min("length").alias("min_bytes"),
        F.max("length").alias("max_bytes"),
        F.percentile_approx("length", 0.5).alias("median_bytes"),
    )


def predict_maintenance(
    stats: DataFrame, medium: int = MEDIUM_FILES, high: int = HIGH_FILES
) -> DataFrame:
    """Priority, urgency and whether compaction is due, from the number of files."""
    n = F.col("file_count")
    return stats.withColumns(
        {
            "priority": F.when(n >= high, "HIGH").when(n >= medium, "MEDIUM").otherwise("LOW"),
            "urgency_score": F.when(n >= high, 0.9).when(n >= medium, 0.6).otherwise(0.2),
            "requires_compaction": n >= medium,
        }
    )


def maintenance_plan(
    stats: DataFrame,
    policy: str = "intelligent",
    force: bool | Column = False,
    sort_columns: Sequence[str] = (),
    medium: int = MEDIUM_FILES,
    high: int = HIGH_FILES,
) -> DataFrame:
    """What to do with each table: rewrite (compact or sort), expire snapshots, or wait.

    ``intelligent``: only HIGH or forced tables are touched, and those are compacted from
    ``medium`` files on; MEDIUM ones are marked for later. ``hybrid``: rewritten when forced
    or from ``high`` files on, sorted when columns are given; snapshots always expire.
    """
    forced = force if isinstance(force, Column) else F.lit(force)
    plan = predict_maintenance(stats, medium, high)
    if policy == "intelligent":
        act = forced | (F.col("priority") == "HIGH")
        rewrite = F.when(act & F.col("requires_compaction"), "compact").otherwise("none")
        expire, later = act, ~act & (F.col("priority") == "MEDIUM")
    elif policy == "hybrid":
        act = forced | (F.col("file_count") >= high)
        rewrite = F.when(act, "sort" if sort_columns else "compact").otherwise("none")
        expire, later = F.lit(True), F.lit(False)
    else:
        raise ValueError(f"unknown policy {policy!r}; known: hybrid, intelligent")
    return plan.withColumns(
        {"rewrite": rewrite, "expire_snapshots": expire, "scheduled_later": later}
    )


NEWEST_BY = ("committed_at", "snapshot_id")


def expired_snapshots(
    manifest: DataFrame,
    retain_last: int = 30,
    by: Sequence[str] = (),
    newest_by: Sequence[str] = NEWEST_BY,
) -> DataFrame:
    """Snapshots older than the newest ``retain_last`` (of each table, with ``by``)."""
    snapshots = _snapshots(manifest, by)
    kept = _newest(snapshots, retain_last, by, newest_by)
    return snapshots.join(kept.select(*by, "snapshot_id"), [*by, "snapshot_id"], "left_anti")


def expired_files(
    manifest: DataFrame,
    retain_last: int = 30,
    by: Sequence[str] = (),
    newest_by: Sequence[str] = NEWEST_BY,
) -> DataFrame:
    """Paths that only expired snapshots use: safe to delete once those are gone.

    A path of an old snapshot that a kept one still uses stays.
    """
    kept = _newest(_snapshots(manifest, by), retain_last, by, newest_by).select(*by, "snapshot_id")
    in_use = manifest.join(kept, [*by, "snapshot_id"], "left_semi").select(*by, "path").distinct()
    return manifest.select(*by, "path").distinct().join(in_use, [*by, "path"], "left_anti")


def orphan_files(listing: DataFrame, manifest: DataFrame, older_than: Column | None = None) -> DataFrame:
    """Files on storage that no snapshot lists.

    Files younger than ``older_than`` are left alone: they may belong to a write under way.
    """
    known = manifest.select("path").distinct()
    if older_than is not None:
        listing = listing.where(F.col("modificationTime") < older_than)
    return listing.join(known, "path", "left_anti")


def _snapshots(manifest: DataFrame, by: Sequence[str]) -> DataFrame:
    return manifest.select(*by, "snapshot_id", "committed_at").distinct()


def _newest(snapshots: DataFrame, n: int, by: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    if n < 1:
        raise ValueError("at least the newest snapshot must be kept")
    order = [F.desc(c) for c in newest_by]
    if not by:
        return snapshots.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return snapshots.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
