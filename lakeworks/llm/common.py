"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.sources.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns never interfere."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """Every row as the struct ``document`` beside ``more``: no column of ``docs`` can clash with those."""
    return docs.select(F.struct("*").alias("document"), *more)


def remainder(column: str, divisor: int) -> Column:
    """The crc32 of the id as decimal text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on each Arrow batch. A batch takes no more rows than keep it small in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                yield work(batch.slice(start, BATCH_ROWS))

    return df.mapInArrow(run, schema)


#: Rows that a task holds at once beyond Spark's own Arrow batch.
BATCH_ROWS = 1000


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def smallest_by_hash(labels: DataFrame, rows: int) -> DataFrame:
    """A sample of at most ``rows`` rows that depends on the ids alone, not on the layout."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
