"""Planning, retrying and tracking a migration that runs in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GB = 1024**3


def batch_plan(files: DataFrame, batch_bytes: int = 2 * GB, digits: int = 3) -> DataFrame:
    """Assign every file (path, length) to a batch of about ``batch_bytes``.

    Files are taken in the order of the md5 of their path; a file belongs to the batch in
    which its first byte falls, so a batch exceeds the limit by less than one file. The
    running sum is taken in two steps to keep it off a single task: inside each of the
    ``16 ** digits`` md5 prefixes, and over the (at most ``16 ** digits``) prefix totals.
    Ids run from 0; a file larger than a batch leaves the ids it covers unused. A listing
    names every path once, so the md5 spreads it evenly.
    """
    if not 1 <= digits <= 4:
        raise ValueError("digits must be 1 to 4: the prefix totals are broadcast")
    keyed = files.select("path", "length", F.md5("path").alias("digest")).withColumn(
        "bucket", F.substring("digest", 1, digits)
    )
    totals = keyed.groupBy("bucket").agg(F.sum("length").alias("bucket_bytes"))
    # At most 16 ** digits rows by construction: small enough for one window and a broadcast.
    offsets = totals.select(
        "bucket",
        (
            F.sum("bucket_bytes").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("bucket_bytes")
        ).alias("offset"),
    )
    in_bucket = (
        Window.partitionBy("bucket")
        .orderBy("digest", "path", "length")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.col("offset") + F.sum("length").over(in_bucket) - F.col("length")
    return keyed.join(F.broadcast(offsets), "bucket").select(
        "path", "length", F.floor(start / F.lit(batch_bytes)).cast("long").alias("batch_id")
    )


def batch_summary(files: DataFrame, batch_bytes: int = 2 * GB, parallelism: int = 4) -> DataFrame:
    """Size of the whole migration, number of batches, and how many to run at a time."""
    batches = F.greatest(F.lit(1), F.ceil(F.col("total_size_bytes") / F.lit(batch_bytes)))
    return (
        files.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_size_bytes"))
        .withColumn("batch_count", batches.cast("long"))
        .withColumn(
            "recommended_parallelism",
            F.least(F.lit(parallelism), F.col("batch_count")).cast("long"),
        )
    )


def batch_state(log: DataFrame) -> DataFrame:
    """Batch log (one row per attempt) reduced to one row per batch.

    Rows and bytes come from the successful attempt, also where it was a retry.
    """
    done = F.col("success")
    return log.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.coalesce(F.bool_or(done), F.lit(False)).alias("done"),
        F.coalesce(F.max(F.when(done, F.col("row_count"))), F.lit(0)).alias("row_count"),
        F.coalesce(F.max(F.when(done, F.col("bytes_processed"))), F.lit(0)).alias("bytes_processed"),
    )


def batches_to_retry(plan: DataFrame, log: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Planned batches that have not succeeded, and what to do with each.

    ``run`` was never tried, ``retry`` failed but may be tried again, ``dead`` has used up
    its attempts (by default the first and three more).
    """
    planned = plan.select("batch_id").distinct()
    attempts = F.coalesce(F.col("attempts"), F.lit(0))
    action = (
        F.when(attempts == 0, "run").when(attempts < max_attempts, "retry").otherwise("dead")
    )
    return (
        planned.join(batch_state(log), "batch_id", "left")
        .where(~F.coalesce(F.col("done"), F.lit(False)))
        .select(
            "batch_id",
            attempts.alias("attempts"),
            action.alias("action"),
            F.when(action == "dead", F.lit("max retries exceeded")).alias("error"),
        )
    )


def migration_progress(
    log: DataFrame,
    total_batches: int | Column,
    total_bytes: int | Column,
    elapsed_seconds: float | Column,
    sla_max_seconds: float | None = None,
) -> DataFrame:
    """Totals, rate, time left and SLA risk of a migration, from its batch log.

    Elapsed time counts as at least one second. Time left is only given when bytes are
    moving and the total is known. The SLA is at risk past 80 % of its limit. A batch that
    succeeded on a retry is completed, not failed.
    """
    elapsed = F.greatest(_lit(elapsed_seconds).cast("double"), F.lit(1.0))
    total = _lit(total_bytes).cast("long")
    at_risk = F.lit(False)
    if sla_max_seconds:
        at_risk = _lit(elapsed_seconds) > F.lit(0.8 * sla_max_seconds)
    rate = F.col("processed_bytes") / elapsed
    return (
        batch_state(log)
        .agg(
            F.count_if("done").alias("completed_batches"),
            F.count_if(~F.col("done")).alias("failed_batches"),
            F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum("bytes_processed"), F.lit(0)).alias("processed_bytes"),
        )
        .select(
            _lit(total_batches).cast("long").alias("total_batches"),
            "completed_batches",
            "failed_batches",
            "total_rows",
            total.alias("total_bytes"),
            "processed_bytes",
            rate.alias("bytes_per_second"),
            F.when(
                (rate > 0) & (total > 0), (total - F.col("processed_bytes")) / rate
            ).alias("seconds_left"),
            at_risk.alias("sla_at_risk"),
        )
    )


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
