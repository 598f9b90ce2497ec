"""One line per run in a log that the metric operators read."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.topk import latest_per_group
from lakeworks.schemas import QUALITY_LOG, RUNS
from lakeworks.sources.audit import WriteResult
from lakeworks.sources.files import append_log, read_log


def log_run(
    spark: SparkSession, log: str | None, job: str, sla_name: str, layer: str, outcome: WriteResult | Exception
) -> None:
    """Record a finished write, or the error that ended it. Without a log: nothing."""
    if log is None:
        return
    row = {"job": job, "sla_name": sla_name, "layer": layer, "ts": datetime.now(timezone.utc)}
    if isinstance(outcome, WriteResult):
        row |= {
            "duration_seconds": outcome.duration_seconds,
            "output_count": outcome.rows,
            "target_count": outcome.target_count,
            "bytes_processed": outcome.bytes_written,
            "success": True,
        }
        quality = {
            "sla_name": sla_name,
            "quality_score": outcome.quality_score,
            "row_count": outcome.rows,
            "ts": row["ts"],
        }
        append_log(spark, f"{log}/quality", QUALITY_LOG, [quality])
    else:
        row |= {"success": False, "error": str(outcome)}
    append_log(spark, f"{log}/runs", RUNS, [row])


def read_runs(spark: SparkSession, log: str) -> DataFrame:
    return read_log(spark, f"{log}/runs", RUNS)


def read_quality(spark: SparkSession, log: str) -> DataFrame:
    return read_log(spark, f"{log}/quality", QUALITY_LOG)


def latest_lines(spark: SparkSession, log: str, k: int = 5) -> DataFrame:
    """The last ``k`` lines of each log, newest first: log, ts, line (as JSON)."""
    line = F.to_json(F.struct("*")).alias("line")
    lines = [
        frame.select(F.lit(name).alias("log"), "ts", line)
        for name, frame in (("runs", read_runs(spark, log)), ("quality", read_quality(spark, log)))
    ]
    return latest_per_group(lines[0].unionAll(lines[1]), ["log"], k, ["ts", "line"]).orderBy("log", "rn")
