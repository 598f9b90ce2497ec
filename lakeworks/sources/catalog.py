"""Tables of the session catalog."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeworks.sources.audit import Gate, WriteResult, clustered, staged_and_checked
from lakeworks.sources.files import file_inventory

MODES = ("create", "overwrite", "append")


def ensure_namespace(spark: SparkSession, table_name: str) -> None:
    """Create the namespace a qualified table name asks for."""
    namespace, _, _ = table_name.rpartition(".")
    if namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")


def is_readable(spark: SparkSession, table_name: str) -> bool:
    """Whether a row of the table can be read (or it is empty)."""
    try:
        spark.table(table_name).limit(1).collect()
    except Exception:
        return False
    return True


@dataclass(frozen=True)
class CatalogTable:
    """A named Parquet table, partitioned and located as given.

    Spark replaces such a table in place: an overwrite that fails midway leaves it empty.
    With a gate the rows are therefore written to the shared folder first and judged there; the table
    gets the very rows that passed.
    Where readers must never miss the table, use ``SnapshotTable``.
    """

    name: str
    partition_by: tuple[str, ...] = ()
    location: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def write(self, df: DataFrame, mode: str = "overwrite", gate: Gate | None = None) -> WriteResult:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
        spark, started = df.sparkSession, time.time()
        df, score = staged_and_checked(df, self.name, gate or Gate())
        ensure_namespace(spark, self.name)
        before, bytes_before = 0, 0
        if mode == "append" and self._exists(spark):
            before, bytes_before = spark.table(self.name).count(), self._bytes(spark)
        observation = Observation()
        counted = clustered(df, self.partition_by).observe(
            observation, F.count(F.lit(1)).alias("row_count")
        )
        writer = counted.write.format("parquet").mode("errorifexists" if mode == "create" else mode)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        if self.location:
            writer = writer.option("path", self.location)
        writer.saveAsTable(self.name)
        return WriteResult(
            target=self.name,
            rows=observation.get["row_count"],
            target_count=spark.table(self.name).count() - before,
            bytes_written=self._bytes(spark) - bytes_before,
            duration_seconds=time.time() - started,
            quality_score=score,
        )

    def _exists(self, spark: SparkSession) -> bool:
        return spark.catalog.tableExists(self.name)

    def _bytes(self, spark: SparkSession) -> int:
        """Bytes of the files below the table's location."""
        described = spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}")
        root = described.where("col_name = 'Location'").first()["data_type"]
        return file_inventory(spark, {self.name: root}).agg(F.sum("length")).first()[0] or 0
