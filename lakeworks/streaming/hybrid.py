"""A batch backfill, then a stream that takes over without gap or overlap."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeworks.sources import fs
from lakeworks.streaming.append import append_stream


@dataclass(frozen=True)
class Hybrid:
    """The running stream and the position up to which the backfill went: as text, or per
    partition where there are some."""

    query: StreamingQuery
    high_water_mark: str | dict[str, str] | None


def backfill_then_stream(
    backfill: DataFrame,
    stream: DataFrame,
    position: str,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    available_now: bool = False,
    partition: str | None = None,
) -> Hybrid:
    """Write ``backfill``, then append what the stream holds beyond it.

    ``position`` must grow in the order rows arrive (an offset, an ingest sequence): within
    each value of ``partition``, if given, or else overall. Its highest values are noted first and
    kept with the checkpoint; the backfill is written up to them and the stream takes what is
    beyond, so rows that arrive during the backfill are not lost and none comes twice. Partitions
    that the backfill does not have go to the stream whole. Rows without a position cannot be
    told apart: both sides keep theirs. A restart after a finished backfill goes straight
    to the stream; one in the middle of it writes the backfill anew, in place of the old.
    """
    spark = backfill.sparkSession
    kind = backfill.schema[position].dataType.simpleString()
    key = F.lit("") if partition is None else F.coalesce(F.col(partition).cast("string"), F.lit(""))

    def beyond(marks: dict[str, str]):
        """True, false, or null for a row without a position."""
        if not marks:
            return F.col(position).isNotNull() | F.lit(None).cast("boolean")
        known = F.create_map(*[F.lit(text) for mark in marks.items() for text in mark])
        last = F.try_element_at(known, key).cast(kind)
        return F.when(F.col(position).isNotNull(), F.coalesce(F.col(position) > last, F.lit(True)))

    marks = _read_marks(spark, checkpoint)
    if marks is None:
        # One row per partition of the source, of which there are few.
        highest = backfill.groupBy(key.alias("key")).agg(F.max(position).cast("string").alias("mark"))
        marks = {r["key"]: r["mark"] for r in highest.where("mark IS NOT NULL").collect()}
        rows = backfill.where(~F.coalesce(beyond(marks), F.lit(False)))
        rows.transform(transform).write.mode("overwrite").parquet(f"{target}/backfill")
        text = spark.createDataFrame([(json.dumps(marks),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{checkpoint}/backfill")
    query = append_stream(
        stream.where(F.coalesce(beyond(marks), F.lit(True))).transform(transform),
        f"{checkpoint}/stream",
        path=f"{target}/stream",
        available_now=available_now,
    )
    return Hybrid(query, marks.get("") if partition is None else marks)


def read_hybrid(spark: SparkSession, target: str) -> DataFrame:
    """Backfilled and streamed rows together; of the stream, committed batches only."""
    backfill = spark.read.parquet(f"{target}/backfill")
    if not fs.exists(spark, f"{target}/stream/_spark_metadata"):
        return backfill
    streamed = spark.read.schema(backfill.schema).parquet(f"{target}/stream")
    return backfill.unionByName(streamed)


def _read_marks(spark: SparkSession, checkpoint: str) -> dict[str, str] | None:
    if not fs.exists(spark, f"{checkpoint}/backfill/_SUCCESS"):
        return None
    return json.loads(spark.read.text(f"{checkpoint}/backfill").first()["value"])
