"""Copying file datasets and tables, whole or in batches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.operators.batches import (
    GB,
    batch_plan,
    batch_state,
    batches_to_retry,
    migration_progress,
)
from lakeworks.operators.dedup import dedup
from lakeworks.operators.quality import require_columns
from lakeworks.plans.runlog import log_run
from lakeworks.schemas import BATCH_LOG
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate, WriteResult
from lakeworks.sources.files import append_log, file_inventory, read_files, read_log

Transform = Callable[[DataFrame], DataFrame]
LOG_SECONDS = 30.0
#: Batches that one job copies: bounds the files it names and what a failure runs again.
BATCHES_PER_JOB = 500
_PATH = "_source_file"


def migrate_dataframe(
    df: DataFrame,
    target,
    mode: str = "overwrite",
    validate: bool = True,
    log: str | None = None,
    job: str = "migration",
    layer: str = "",
    sla_name: str = "batch_migration",
    gate: Gate | None = None,
) -> WriteResult:
    """Write a frame and compare the rows handed to the writer with the rows on storage.

    For an append only the rows it added are compared. A mismatch raises.
    """
    spark = df.sparkSession
    try:
        result = target.write(df, mode, gate)
        if validate and result.rows != result.target_count:
            raise RuntimeError(
                f"Row count mismatch: source={result.rows}, target={result.target_count}"
            )
    except Exception as error:
        log_run(spark, log, job, sla_name, layer, error)
        raise
    log_run(spark, log, job, sla_name, layer, result)
    return result


def migrate_files(
    spark: SparkSession,
    source_path: str,
    target,
    fmt: str = "parquet",
    mode: str = "overwrite",
    schema: T.StructType | str | None = None,
    validate: bool = True,
    log: str | None = None,
) -> WriteResult:
    """Copy a file dataset into a table."""
    return migrate_dataframe(read_files(spark, source_path, fmt, schema), target, mode, validate, log)


def run_governed(
    spark: SparkSession,
    source,
    target,
    transform: Transform,
    required: Sequence[str] = (),
    gate: Gate | None = None,
    log: str | None = None,
    job: str = "etl",
    sla_name: str = "critical_etl",
    mode: str = "overwrite",
) -> WriteResult:
    """Table -> transform -> table, with checks on the way in and before publishing."""
    try:
        rows = require_columns(source.read(spark), required).transform(transform)
    except Exception as error:
        log_run(spark, log, job, sla_name, "", error)
        raise
    return migrate_dataframe(rows, target, mode, True, log, job, sla_name=sla_name, gate=gate)


def copy_table(
    spark: SparkSession,
    source,
    target,
    dedup_keys: Sequence[str] = (),
    min_rows: int = 0,
    log: str | None = None,
) -> WriteResult:
    """Table -> table, as it is or with one row per key."""
    return run_governed(
        spark,
        source,
        target,
        lambda df: dedup(df, dedup_keys),
        required=dedup_keys,
        gate=Gate(min_rows=min_rows),
        log=log,
        job="table_to_table",
    )


def migrate_in_batches(
    spark: SparkSession,
    source_path: str,
    target_root: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    batch_bytes: int = 2 * GB,
    parallelism: int = 4,
    max_retries: int = 3,
    backoff_seconds: float = 5.0,
    transform: Transform | None = None,
    sla_max_seconds: float | None = None,
    batches_per_job: int = BATCHES_PER_JOB,
) -> DataFrame:
    """Copy a large file dataset in batches of files; returns the progress row.

    ``<target_root>/plan`` says which file is in which batch, ``rows/batch_id=<n>`` holds the
    rows of a batch (a second run of it replaces them), ``log`` every attempt. Calling this
    again carries on where it stopped: batches that succeeded are not run again. One Spark job
    writes up to ``batches_per_job`` batches: rows get their batch from the file they come from, and
    only the folders of these batches are replaced. If it fails, its batches are run in two halves,
    down to the batch that is to blame; that one counts as failed. ``parallelism`` jobs share the
    cluster. ``transform`` sees the rows of many batches with their ``batch_id``, which it must keep.
    Without a ``schema`` one is inferred over the whole source and kept in ``schema`` for all batches
    and restarts, so files with different columns end up with all of them.
    """
    started = time.time()
    plan_path, log_path = f"{target_root}/plan", f"{target_root}/log"
    schema_path = f"{target_root}/schema"
    if not fs.exists(spark, f"{plan_path}/_SUCCESS"):
        listing = file_inventory(spark, {"source": source_path})
        # Sorted, so that looking up some batches reads few row groups.
        planned = batch_plan(listing, batch_bytes).orderBy("batch_id", "path")
        planned.write.mode("overwrite").parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    total = plan.agg(F.count_distinct("batch_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if schema is None and total[0]:
        schema = _common_schema(spark, source_path, fmt, schema_path)

    def copy(batches: dict[int, int]) -> list[dict]:
        """Copy some batches (number -> attempts before) in one job; a line of the log for each."""
        begun = time.time()
        try:
            # What an attempt left that wrote its rows and failed afterwards.
            fs.delete_all(spark, [f"{target_root}/rows/batch_id={n}" for n, tried in batches.items() if tried])
            found = _copy_batches(spark, plan, list(batches), source_path, f"{target_root}/rows", fmt, schema, transform)
            outcome = {n: {"row_count": r, "bytes_processed": size, "success": True} for n, (r, size) in found.items()}
        except Exception as error:
            if len(batches) > 1:
                numbers = sorted(batches)
                halves = numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :]
                return [row for half in halves for row in copy({n: batches[n] for n in half})]
            failed = {"row_count": 0, "bytes_processed": 0, "success": False, "error": str(error)}
            outcome = dict.fromkeys(batches, failed)
        seconds = {"duration_seconds": time.time() - begun}
        return [{"batch_id": n, "attempt": batches[n] + 1} | row | seconds for n, row in outcome.items()]

    # The loop goes over batch ids, not data: one round of first tries, then the retries.
    for attempt in range(1 + max_retries):
        todo = sorted(
            (r["batch_id"], r["attempts"])
            for r in batches_to_retry(plan, _log(spark, log_path), 1 + max_retries).collect()
            if r["action"] != "dead"
        )
        if not todo:
            break
        if attempt:
            time.sleep(backoff_seconds * attempt)
        parts = [dict(todo[i : i + batches_per_job]) for i in range(0, len(todo), batches_per_job)]
        with ThreadPoolExecutor(min(parallelism, len(parts))) as pool:
            if _log_as_they_finish(spark, log_path, [pool.submit(copy, part) for part in parts]):
                break
    return migration_progress(
        _log(spark, log_path), total[0], total[1], time.time() - started, sla_max_seconds
    )


def _copy_batches(
    spark: SparkSession,
    plan: DataFrame,
    batches: Sequence[int],
    source_path: str,
    target: str,
    fmt: str,
    schema: T.StructType | str | None,
    transform: Transform | None,
) -> dict[int, tuple[int, int]]:
    """Write the rows of some batches, each to its folder; rows and source bytes by batch.

    The batch of a file comes from a broadcast of the files of these batches, whose names this
    job needs on the driver anyway to be given to the reader.
    """
    files = plan.where(F.col("batch_id").isin(list(batches))).select("path", "length", "batch_id")
    names = files.collect()
    reader = spark.read.format(fmt).option("basePath", source_path)
    reader = reader.option("header", True) if fmt == "csv" else reader
    reader = reader.schema(schema) if schema is not None else reader
    # File paths of rows are URI-encoded, where listings are not.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = reader.load([f["path"] for f in names]).withColumn(_PATH, path)
    own = files.select(F.col("path").alias(_PATH), "batch_id")
    rows = rows.join(F.broadcast(own), _PATH).drop(_PATH)
    rows = rows.transform(transform) if transform else rows
    if "batch_id" not in rows.columns:
        raise ValueError("the transform dropped batch_id")
    count = Observation()
    rows = rows.observe(count, F.count(F.lit(1)).alias("n"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(target)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "batch_id"] + [T.StructField("batch_id", T.LongType())])
    stored = spark.read.schema(schema).parquet(target).where(F.col("batch_id").isin(list(batches)))
    found = dict(stored.groupBy("batch_id").count().collect()) if count.get["n"] else {}
    if sum(found.values()) != count.get["n"]:
        raise RuntimeError(f"Row count mismatch: source={count.get['n']}, target={sum(found.values())}")
    size = dict.fromkeys(batches, 0)
    for f in names:
        size[f["batch_id"]] += f["length"]
    return {n: (found.get(n, 0), size[n]) for n in batches}


def _common_schema(spark: SparkSession, source_path: str, fmt: str, kept: str) -> T.StructType:
    """The columns of all files together, inferred once and then read from ``kept``."""
    if not fs.exists(spark, f"{kept}/_SUCCESS"):
        # json is inferred over all lines; of parquet and orc all footers are merged, in tasks.
        reader = spark.read.format(fmt).option("mergeSchema", fmt in ("parquet", "orc")).option("header", True)
        found = reader.load(source_path).schema
        text = spark.createDataFrame([(found.json(),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(kept)
    return T.StructType.fromJson(json.loads(spark.read.text(kept).first()["value"]))


def read_batches(spark: SparkSession, target_root: str) -> DataFrame:
    """All rows of the batches that succeeded; what an interrupted one left is not read."""
    done = batch_state(_log(spark, f"{target_root}/log")).where("done").select("batch_id")
    return spark.read.parquet(f"{target_root}/rows").join(done, "batch_id", "left_semi").drop("batch_id")


def _log_as_they_finish(spark: SparkSession, path: str, jobs: Sequence[Future]) -> bool:
    """Log results together every so often: with many thousand batches, one write each would
    be what the run waits for. What a lost driver had not logged yet is run again, which
    replaces the same rows. Returns whether all batches succeeded."""
    finished, flushed, good = [], time.time(), True
    for left, job in zip(range(len(jobs) - 1, -1, -1), as_completed(jobs)):
        finished += job.result()
        good = good and all(row["success"] for row in finished)
        if not left or time.time() - flushed >= LOG_SECONDS:
            append_log(spark, path, BATCH_LOG, finished)
            finished, flushed = [], time.time()
    return good


def _log(spark: SparkSession, path: str) -> DataFrame:
    if not fs.exists(spark, path):
        return spark.createDataFrame([], BATCH_LOG)
    return read_log(spark, path, BATCH_LOG)
