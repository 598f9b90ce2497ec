"""JSON lines -> bronze -> silver -> gold."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.cleanse import bronze_enrich, bronze_to_silver
from lakeworks.operators.quality import require_columns
from lakeworks.operators.report import gold_daily_report
from lakeworks.plans.generate import generate_json_lines
from lakeworks.plans.migrate import migrate_dataframe
from lakeworks.plans.runlog import log_run
from lakeworks.sources.audit import Gate, WriteResult
from lakeworks.sources.files import CORRUPT, bad_records, good_records, read_json_lines
from lakeworks.sources.snapshots import SnapshotTable


@dataclass(frozen=True)
class IngestResult:
    bronze: WriteResult
    quarantined: bool


def layer_tables(root: str) -> tuple[SnapshotTable, SnapshotTable, SnapshotTable]:
    """Bronze, silver and gold below a root, partitioned by day as their readers filter them."""
    return (
        SnapshotTable(f"{root}/bronze/transactions", ("transaction_date",)),
        SnapshotTable(f"{root}/silver/transactions", ("transaction_date",)),
        SnapshotTable(f"{root}/gold/daily_report", ("report_date",)),
    )


def ingest_json(
    spark: SparkSession,
    source_path: str,
    bronze,
    mode: str = "overwrite",
    quarantine_path: str | None = None,
    ingest_ts: datetime | None = None,
    log: str | None = None,
) -> IngestResult:
    """Read JSON lines, add the ingest columns, publish as bronze, check the counts.

    The lines are parsed once. Bad lines are seen on the way; only if there are any, a second
    pass writes them out whole: to ``quarantine_path``, or else beside the bronze table. Where
    bronze is overwritten they are too, so a replay does not double them.
    """
    raw = read_json_lines(spark, source_path)
    seen = Observation()
    watched = raw.observe(seen, F.count_if(F.col(CORRUPT).isNotNull()).alias("bad"))
    rows = bronze_enrich(good_records(watched), source_path, ingest_ts)
    result = migrate_dataframe(rows, bronze, mode, log=log, job="json_to_bronze", layer="bronze")
    has_bad = bool(seen.get["bad"])
    if has_bad:
        place = bad_records(raw).write.mode("overwrite" if mode == "overwrite" else "append")
        if quarantine_path or isinstance(bronze, SnapshotTable):
            place.json(quarantine_path or f"{bronze.root}.bad_lines")
        else:
            place.saveAsTable(f"{bronze.name}_bad_lines")
    return IngestResult(result, has_bad)


def bronze_to_gold(
    spark: SparkSession, bronze, silver, gold, silver_gate: Gate | None = None, log: str | None = None
) -> dict[str, WriteResult]:
    """Cleanse bronze into silver, then report on the stored silver table."""
    source = require_columns(bronze.read(spark), ["transaction_id", "amount"])
    results = {}
    steps = (
        ("silver", silver, lambda: bronze_to_silver(source), silver_gate),
        ("gold", gold, lambda: gold_daily_report(silver.read(spark)), None),
    )
    for layer, target, rows, gate in steps:
        try:
            results[layer] = target.write(rows(), "overwrite", gate)
        except Exception as error:
            log_run(spark, log, "bronze_to_report", "critical_etl", layer, error)
            raise
        log_run(spark, log, "bronze_to_report", "critical_etl", layer, results[layer])
    return results


def generate_to_gold(
    spark: SparkSession, root: str, target_bytes: int, log: str | None = None
) -> dict[str, WriteResult]:
    """Synthetic JSON lines, ingested, cleansed and reported, all below one root."""
    bronze, silver, gold = layer_tables(root)
    generate_json_lines(spark, f"{root}/raw", target_bytes)
    ingested = ingest_json(spark, f"{root}/raw", bronze, quarantine_path=f"{root}/bad", log=log)
    return {"bronze": ingested.bronze} | bronze_to_gold(spark, bronze, silver, gold, log=log)
