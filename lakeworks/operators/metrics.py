"""Throughput, SLA and quality summaries over the run logs."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.operators.topk import latest_per_group
from lakeworks.schemas import SLAS, Sla


def throughput(runs: DataFrame) -> DataFrame:
    """Rows and bytes per second of every run.

    A run counts as at least a millisecond long; its rows are the output count, else the
    target count, else none.
    """
    seconds = F.greatest(F.coalesce(F.col("duration_seconds"), F.lit(1.0)), F.lit(0.001))
    rows = F.coalesce(F.col("output_count"), F.col("target_count"), F.lit(0))
    size = F.coalesce(F.col("bytes_processed"), F.lit(0))
    return runs.withColumns(
        {
            "job": F.coalesce(F.col("job"), F.lit("unknown")),
            "rows_per_second": rows / seconds,
            "bytes_per_second": size / seconds,
        }
    )


def latest_throughput(runs: DataFrame) -> DataFrame:
    """The newest sample of every job."""
    samples = throughput(runs).select("job", "ts", "rows_per_second", "bytes_per_second")
    order = ["ts", "rows_per_second", "bytes_per_second"]
    return latest_per_group(samples, ["job"], 1, order).drop("rn")


def sla_compliance(runs: DataFrame, slas: Sequence[Sla] = SLAS) -> DataFrame:
    """Per SLA: runs, failures, breaches, runs at risk, success rate and the verdict.

    A run complies when it did not fail and stayed within the limit; it breaches when it
    finished late and is at risk past the alert share of the limit. An SLA holds when all
    its runs stayed within the limit and enough of them succeeded. Runs of an unknown SLA, or of
    none, have a row too, with a null verdict. Runs are counted per SLA
    before the (constant-size) profile table is joined, so no run is shuffled for the join.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    names = ("sla_name", "max_execution_seconds", "min_success_rate", "alert_threshold")
    values = [(s.name, s.max_execution_seconds, s.min_success_rate, s.alert_threshold) for s in slas]
    listed = F.from_json(
        F.lit(json.dumps([dict(zip(names, v)) for v in values])),
        "array<struct<sla_name:string,max_execution_seconds:int,min_success_rate:double,alert_threshold:double>>",
    )
    profiles = runs.sparkSession.range(1).select(F.inline(listed))
    late, risky = F.lit(False), F.lit(False)
    for s in slas:
        of_sla = F.col("sla_name") == s.name
        late = late | (of_sla & (F.col("duration_seconds") > s.max_execution_seconds))
        risky = risky | (
            of_sla & (F.col("duration_seconds") > s.alert_threshold * s.max_execution_seconds)
        )
    counted = runs.groupBy("sla_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & late).alias("breaches"),
        F.count_if(risky).alias("at_risk"),
        F.count_if(ok & ~late).alias("compliant"),
    )
    rate = F.try_divide(F.col("runs") - F.col("failed"), F.col("runs"))
    return (
        counted.join(F.broadcast(profiles), "sla_name", "left")
        .withColumn("success_rate", rate)
        .select(
            "sla_name",
            "runs",
            "failed",
            "breaches",
            "at_risk",
            "compliant",
            "success_rate",
            (
                (F.col("breaches") == 0) & (F.col("success_rate") >= F.col("min_success_rate"))
            ).alias("sla_met"),
        )
    )


def quality_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of checks and mean score (1 when there are none), overall or per ``by``."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"),
        F.coalesce(F.avg("quality_score"), F.lit(1.0)).alias("average_quality_score"),
    )


def latest_checks(log: DataFrame, k: int = 10, newest_by: Iterable[str] = ("ts",)) -> DataFrame:
    """The last ``k`` quality checks, newest first."""
    order = [F.col(c).desc_nulls_last() for c in newest_by]
    return log.orderBy(*order).limit(k)
