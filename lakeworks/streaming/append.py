"""Source -> transform -> append, as a checkpointed stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeworks.operators.cleanse import positive, successful, typed
from lakeworks.schemas import RAW, SILVER_COLUMNS
from lakeworks.sources.files import CORRUPT

_PLACE = ("partition", "offset", "timestamp")


def read_stream(
    spark: SparkSession,
    fmt: str,
    schema: T.StructType = RAW,
    path: str | None = None,
    options: Mapping[str, str] | None = None,
    per_batch: int | None = None,
) -> DataFrame:
    """Rows from Kafka (JSON values) or from files as they arrive.

    ``per_batch`` bounds a batch, in files or in Kafka's offsets; without it one batch takes
    all there is. Kafka starts at the latest offsets unless told otherwise, and needs its package on the
    classpath.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    if per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger" if fmt == "kafka" else "maxFilesPerTrigger", per_batch)
    if fmt != "kafka":
        return reader.schema(schema).load(path)
    if "startingOffsets" not in (options or {}):
        reader = reader.option("startingOffsets", "latest")
    return parse_values(reader.load(), schema)


def parse_values(stream: DataFrame, schema: T.StructType = RAW) -> DataFrame:
    """The JSON in a binary ``value`` column as columns.

    A value that is no JSON, or holds one of the wrong type, has its text in ``_corrupt_record``.
    The place of a Kafka message stays beside it, as ``kafka_partition``, ``kafka_offset`` and
    ``kafka_timestamp``.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    place = {f"kafka_{c}": F.col(c) for c in _PLACE if c in stream.columns}
    return stream.select(parsed.alias("r"), *[c.alias(n) for n, c in place.items()]).select("r.*", *place)


def silver_stream(raw: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The silver rules on a stream.

    State is kept per transaction id for ``delay`` after it arrived. The first copy to arrive
    stays, where a batch keeps the newest: they agree when copies are equal and arrive within
    ``delay`` of each other. The watermark follows arrival, not the transactions' own time, so
    no row is late, however old it is and however the input is cut into batches; rows without
    a timestamp stay as well.
    """
    rows = raw.transform(typed).transform(successful).transform(positive)
    return (
        rows.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(["transaction_id"])
        .select(*SILVER_COLUMNS)
    )


def append_stream(
    rows: DataFrame,
    checkpoint: str,
    table: str | None = None,
    path: str | None = None,
    partition_by: Sequence[str] = (),
    available_now: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Start appending a stream to a table or a Parquet path.

    ``checkpoint`` must outlive the driver: with it a restart goes on exactly where the last
    run stopped. ``available_now`` works off what is there and stops;
    started again without it from the same checkpoint, the stream carries on from there.
    """
    if (table is None) == (path is None):
        raise ValueError("give either a table or a path")
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    if table is not None:
        return writer.format("parquet").toTable(table)
    return writer.format("parquet").start(path)
