"""The jobs from a command line: ``spark-submit ... -m lakeworks`` or ``python -m lakeworks``.

The session's settings (catalog, sizes, shared folders) come from spark-submit.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lakeworks.operators.metrics import latest_throughput, quality_summary, sla_compliance
from lakeworks.plans import generate, maintain, medallion, migrate, runlog
from lakeworks.sources.catalog import MODES, CatalogTable
from lakeworks.sources.files import FORMATS
from lakeworks.sources.iceberg import IcebergTable, is_iceberg_catalog
from lakeworks.sources.snapshots import SnapshotTable


def open_table(spark: SparkSession, name: str, partition_by: Sequence[str] = ()):
    """A snapshot table for a path, else a table of the catalog (Iceberg where that is)."""
    if "/" in name:
        return SnapshotTable(name, tuple(partition_by))
    named = IcebergTable(name, tuple(partition_by))
    return named if is_iceberg_catalog(spark, named.catalog) else CatalogTable(name, tuple(partition_by))


def names(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakeworks")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, log: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=text)
        if log:
            p.add_argument("--log", help="directory of the run log")
        return p

    p = job("generate", "synthetic transactions as JSON lines", log=False)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--target-gb", type=float, default=10.0)

    p = job("ingest", "JSON lines to a bronze table")
    p.add_argument("--source-path", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--mode", default="overwrite", choices=MODES)
    p.add_argument("--quarantine-path")

    p = job("report", "bronze to silver to the daily report")
    for layer in ("bronze", "silver", "gold"):
        p.add_argument(f"--{layer}", required=True)

    p = job("migrate", "a file dataset to a table")
    p.add_argument("--source-path", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--format", default="parquet", choices=FORMATS)
    p.add_argument("--mode", default="overwrite", choices=MODES)
    p.add_argument("--partition-cols", type=names, default=[])

    p = job("copy", "a table to a table, as it is or with one row per key")
    p.add_argument("--source", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--dedup-keys", type=names, default=[])
    p.add_argument("--min-rows", type=int, default=0)

    p = job("maintain", "compact or sort tables, expire their snapshots", log=False)
    p.add_argument("--table", required=True, action="append", help="path of a snapshot table; may be repeated")
    p.add_argument("--policy", default="hybrid", choices=["hybrid", "intelligent"])
    p.add_argument("--force", action="store_true")
    p.add_argument("--sort", type=names, default=[])
    p.add_argument("--zorder", action="store_true", help="interleave the sort columns")
    p.add_argument("--retain-last", type=int, default=30)

    p = job("metrics", "what the run log says")
    p.add_argument("--lines", type=int, default=5)
    return top


def run(spark: SparkSession, a: argparse.Namespace):
    """Run one job; returns what it reports."""
    if a.job == "generate":
        return generate.generate_json_lines(spark, a.output_dir, int(a.target_gb * generate.GB))
    if a.job == "ingest":
        bronze = open_table(spark, a.target, ["transaction_date"])
        return medallion.ingest_json(spark, a.source_path, bronze, a.mode, a.quarantine_path, log=a.log)
    if a.job == "report":
        silver = open_table(spark, a.silver, ["transaction_date"])
        gold = open_table(spark, a.gold, ["report_date"])
        return medallion.bronze_to_gold(spark, open_table(spark, a.bronze), silver, gold, log=a.log)
    if a.job == "migrate":
        target = open_table(spark, a.target, a.partition_cols)
        return migrate.migrate_files(spark, a.source_path, target, a.format, a.mode, log=a.log)
    if a.job == "copy":
        source, target = open_table(spark, a.source), open_table(spark, a.target)
        return migrate.copy_table(spark, source, target, a.dedup_keys, a.min_rows, a.log)
    if a.job == "maintain":
        tables = {path: SnapshotTable.existing(spark, path) for path in a.table}
        return maintain.maintain(spark, tables, a.policy, a.force, a.sort, a.retain_last, zorder=a.zorder)
    runs = runlog.read_runs(spark, a.log)
    for frame in (
        latest_throughput(runs),
        sla_compliance(runs),
        quality_summary(runlog.read_quality(spark, a.log)),
        runlog.latest_lines(spark, a.log, a.lines),
    ):
        frame.show(truncate=False)
    return None


def main(argv: Sequence[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lakeworks-{arguments.job}").getOrCreate()
    print(run(spark, arguments))


if __name__ == "__main__":
    main()
