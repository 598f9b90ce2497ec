"""A stream into a folder of epochs, each published once and only if it passes its gate.

Layout under the root::

    rows/epoch=<n>/*.parquet     the rows of one batch of the stream
    published/<n>.json           there once epoch n has been checked

A batch is written to the folder of its epoch, checked as it lies there, and published by its
marker. If the driver is lost in between, Spark runs the batch again under the same number: without
a marker the folder is written anew, with one nothing is done. So a batch appears once, however
often it runs. Readers see published epochs only. A folder belongs to one checkpoint.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeworks.operators.quality import measures
from lakeworks.plans.runlog import log_run
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate, WriteResult, check, clustered
from lakeworks.sources.files import file_inventory

EPOCH = "epoch"
MARKER = T.StructType([T.StructField(EPOCH, T.LongType()), T.StructField("rows", T.LongType())])


def publish_epoch(
    rows: DataFrame, epoch: int, root: str, gate: Gate | None = None, partition_by: Sequence[str] = ()
) -> WriteResult | None:
    """Write, check and publish one batch; ``None`` if that epoch is published already.

    A batch that fails its gate raises ``DataQualityError`` and leaves no rows behind.
    """
    spark, gate, started = rows.sparkSession, gate or Gate(), time.time()
    marker, folder = f"{root}/published/{epoch:012d}.json", f"{root}/rows/{EPOCH}={epoch}"
    if fs.exists(spark, marker):
        return None
    writer = clustered(rows, partition_by).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    written = spark.read.schema(rows.schema).parquet(folder)
    counts = written.agg(*measures(gate.observable)).first().asDict()
    try:
        score = check(spark, folder, gate, counts, written)
    except Exception:
        fs.delete(spark, folder)
        raise
    size = file_inventory(spark, {"epoch": folder}).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    fs.write_new(spark, marker, json.dumps({EPOCH: epoch, "rows": counts["row_count"]}) + "\n")
    return WriteResult(root, counts["row_count"], counts["row_count"], size, time.time() - started, score)


def publish_stream(
    rows: DataFrame,
    root: str,
    checkpoint: str,
    gate: Gate | None = None,
    partition_by: Sequence[str] = (),
    output_mode: str = "append",
    available_now: bool = False,
    every: str | None = None,
    log: str | None = None,
) -> StreamingQuery:
    """Start a stream whose batches are published by ``publish_epoch``.

    A batch that fails its gate stops the stream; started again, it tries that batch again. ``log``
    gets a line per published epoch, and one for the error that stopped the stream.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        try:
            result = publish_epoch(batch, epoch, root, gate, partition_by)
        except Exception as error:
            log_run(batch.sparkSession, log, "stream", "critical_etl", "", error)
            raise
        if result is not None:
            log_run(batch.sparkSession, log, "stream", "critical_etl", "", result)

    writer = rows.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(publish)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


def epochs(spark: SparkSession, root: str) -> DataFrame:
    """``epoch`` and ``rows`` of what is published."""
    if not fs.child_names(spark, f"{root}/published"):
        return spark.createDataFrame([], MARKER)
    return spark.read.schema(MARKER).json(f"{root}/published")


def read_published(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all published epochs, with ``epoch``; the folders of others are not read."""
    if not fs.exists(spark, f"{root}/rows"):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType())]))
    with_epoch = T.StructType([*schema.fields, T.StructField(EPOCH, T.LongType())])
    rows = spark.read.schema(with_epoch).parquet(f"{root}/rows")
    return rows.join(epochs(spark, root).select(EPOCH), EPOCH, "left_semi").select(*with_epoch.fieldNames())
