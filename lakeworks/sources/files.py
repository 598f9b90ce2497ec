"""File datasets, JSON lines, file listings and append-only logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.schemas import RAW

FORMATS = ("parquet", "orc", "json", "csv", "avro")
CORRUPT = "_corrupt_record"


def read_files(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A directory of files in one of the known formats.

    Give a schema for json and csv: without one Spark reads json twice to infer it, and csv
    columns are all text. csv files have a header line. avro needs its package on the
    classpath.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "json":
        reader = reader.option("multiLine", False)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path if isinstance(path, str) else list(path))


def read_json_lines(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW
) -> DataFrame:
    """JSON lines with a known schema, plus ``_corrupt_record`` with the text of bad lines."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path if isinstance(path, str) else list(path))
    )


def good_records(df: DataFrame) -> DataFrame:
    """Lines that fit the schema."""
    return df.where(F.col(CORRUPT).isNull() | _is_own_text(df)).drop(CORRUPT)


def bad_records(df: DataFrame) -> DataFrame:
    """Lines that are no JSON or hold a value of the wrong type, with their full text."""
    return df.where(F.col(CORRUPT).isNotNull() & ~_is_own_text(df))


def _is_own_text(df: DataFrame):
    # Never true, and only looked at for bad lines. It names every column because Spark parses
    # just the columns a query asks for: a value of the wrong type in a column that was pruned
    # away would not be noticed, and a count would depend on what else is selected.
    values = F.struct(*[F.col(c) for c in df.columns if c != CORRUPT])
    return F.coalesce(F.to_json(values) == F.col(CORRUPT), F.lit(False))


def file_inventory(spark: SparkSession, tables: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Data files of several tables (name -> root or roots): table, partition, path, length, time.

    Only the file status is read, never the content. Spark sizes its tasks by file length,
    which means nothing here, so they are merged to a few per core.
    """
    return reduce(DataFrame.unionAll, [_listing(spark, name, r) for name, r in tables.items()])


def _listing(spark: SparkSession, name: str, roots: str | Sequence[str]) -> DataFrame:
    parts = F.split("path", "/")
    partition = F.filter(parts, lambda part: part.contains("=") & ~part.startswith("load="))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load([roots] if isinstance(roots, str) else list(roots))
        .select(
            F.lit(name).alias("table"),
            F.array_join(partition, "/").alias("partition"),
            "path",
            "length",
            "modificationTime",
        )
        .coalesce(spark.sparkContext.defaultParallelism * 4)
    )


def append_log(
    spark: SparkSession, path: str, schema: T.StructType, rows: Sequence[Mapping[str, Any]]
) -> None:
    """Append a few rows to a JSON-lines log that any reader of ``read_log`` can query."""
    tuples = [tuple(row.get(f) for f in schema.fieldNames()) for row in rows]
    spark.createDataFrame(tuples, schema).coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
