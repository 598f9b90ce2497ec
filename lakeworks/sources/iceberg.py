"""Iceberg tables, for sessions whose catalog has them.

UNTESTED here: the Iceberg package is not on this build's classpath. The calls are those of
Iceberg's public Spark procedures; everything else in the package works without it.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.files import TARGET_FILE_BYTES
from lakeworks.operators.quality import measures
from lakeworks.sources.audit import Gate, WriteResult, check, clustered
from lakeworks.sources.catalog import ensure_namespace


def is_iceberg_catalog(spark: SparkSession, catalog: str = "spark_catalog") -> bool:
    return "iceberg" in spark.conf.get(f"spark.sql.catalog.{catalog}", "").lower()


@dataclass(frozen=True)
class IcebergTable:
    """A named Iceberg table with the same read and write calls as the other tables."""

    name: str
    partition_by: tuple[str, ...] = ()
    location: str | None = None
    target_bytes: int = TARGET_FILE_BYTES

    @property
    def catalog(self) -> str:
        return self.name.split(".")[0] if self.name.count(".") > 1 else "spark_catalog"

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def files(self, spark: SparkSession, name: str | None = None) -> DataFrame:
        """The newest version's data files, in the columns of other listings (no times)."""
        return spark.table(f"{self.name}.files").selectExpr(
            f"'{name or self.name}' AS table",
            "CAST(NULL AS STRING) AS partition",
            "file_path AS path",
            "file_size_in_bytes AS length",
            "CAST(NULL AS TIMESTAMP) AS modificationTime",
        )

    def write(self, df: DataFrame, mode: str = "overwrite", gate: Gate | None = None) -> WriteResult:
        spark, started, gate, score = df.sparkSession, time.time(), gate or Gate(), 1.0
        self._require(spark)
        if gate.rules or gate.min_rows:
            counts = df.agg(*measures(gate.observable)).first().asDict()
            score = check(spark, self.name, gate, counts, df)
        ensure_namespace(spark, self.name)
        before = spark.table(self.name).count() if mode == "append" else 0
        observation = Observation()
        counted = clustered(df, self.partition_by).observe(
            observation, F.count(F.lit(1)).alias("row_count")
        )
        writer = counted.writeTo(self.name).using("iceberg")
        writer = writer.tableProperty("write.target-file-size-bytes", str(self.target_bytes))
        if self.location:
            writer = writer.tableProperty("location", self.location)
        if self.partition_by:
            writer = writer.partitionedBy(*[F.col(c) for c in self.partition_by])
        {"append": writer.append, "create": writer.create, "overwrite": writer.createOrReplace}[mode]()
        return WriteResult(
            target=self.name,
            rows=observation.get["row_count"],
            target_count=spark.table(self.name).count() - before,
            bytes_written=0,
            duration_seconds=time.time() - started,
            quality_score=score,
        )

    def compact(self, spark: SparkSession, target_bytes: int | None = None) -> None:
        self._rewrite(spark, target_bytes)

    def rewrite_sorted(
        self, spark: SparkSession, columns: Sequence[str], target_bytes: int | None = None, zorder: bool = False
    ) -> None:
        order = f"zorder({','.join(columns)})" if zorder else ",".join(columns)
        self._rewrite(spark, target_bytes, f"strategy => 'sort', sort_order => '{order}', ")

    def _rewrite(self, spark: SparkSession, target_bytes: int | None, how: str = "") -> None:
        size = target_bytes or self.target_bytes
        self._call(spark, "rewrite_data_files", f"{how}options => map('target-file-size-bytes', '{size}')")

    def expire_snapshots(self, spark: SparkSession, retain_last: int = 30) -> None:
        self._call(spark, "expire_snapshots", f"retain_last => {retain_last}")

    def remove_orphan_files(self, spark: SparkSession) -> None:
        self._call(spark, "remove_orphan_files")

    def _call(self, spark: SparkSession, procedure: str, arguments: str = "") -> None:
        self._require(spark)
        rest = f", {arguments}" if arguments else ""
        spark.sql(f"CALL {self.catalog}.system.{procedure}(table => '{self.name}'{rest})")

    def _require(self, spark: SparkSession) -> None:
        if not is_iceberg_catalog(spark, self.catalog):
            raise RuntimeError(f"{self.catalog} is no Iceberg catalog in this session")
