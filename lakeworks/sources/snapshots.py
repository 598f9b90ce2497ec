"""Parquet tables published in snapshots.

Layout under the table's root::

    data/load=<id>/<partition dirs>/*.parquet    one directory per write, never changed
    manifest/<n>.json                            the directories that make up version n (and the
                                                 files, of directories it takes in part)

A write lands in a load directory of its own, is audited there, and becomes visible when its
manifest (one small file) appears. Readers see a whole version or the one before, and no data
file is ever moved or changed. Of two writers that want to commit the same version, one finds
it taken: an append follows the version that won, any other write fails, takes its files away and
leaves the table as the other made it; it may simply run again. (Where
the storage cannot rename in one step, as some object stores, the caller must keep writers of
one table apart.)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.operators.files import TARGET_FILE_BYTES, expired_files, expired_snapshots, orphan_files
from lakeworks.operators.reconcile import reconcile, reconcile_counts
from lakeworks.operators.zorder import with_zorder
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate, WriteResult, check, clustered, observed_measures
from lakeworks.sources.files import file_inventory

MANIFEST = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("of_load", T.LongType()),
        T.StructField("schema", T.StringType()),
        T.StructField("partition_by", T.ArrayType(T.StringType())),
    ]
)
SNAPSHOT_COLUMNS = ["snapshot_id", "committed_at", "path"]
# Path below ``data`` of a directory -> number of directories its load has in all; of a file -> 0.
Directories = dict[str, int]
# Files below this share of the wanted size are worth merging.
SMALL_SHARE = 0.75
# Groups of small files rewritten by one job: bounds the size of its plan.
GROUPS_PER_JOB = 200
# Values (rows times columns) that one task sorts: some 1 GB of memory, however well they compress.
SORT_VALUES = 64 << 20


@dataclass(frozen=True)
class SnapshotTable:
    """A table under ``root``, optionally partitioned."""

    root: str
    partition_by: tuple[str, ...] = ()

    @classmethod
    def existing(cls, spark: SparkSession, root: str) -> SnapshotTable:
        """A table that has been written, with the partition columns it was written with."""
        unpartitioned = cls(root)
        if not unpartitioned.snapshot_ids(spark):
            raise FileNotFoundError(f"{root}: no snapshots")
        return cls(root, unpartitioned._stored_partitions(spark))

    # ---- reading

    def snapshot_ids(self, spark: SparkSession) -> list[int]:
        names = fs.child_names(spark, f"{self.root}/manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit())

    def manifest(self, spark: SparkSession) -> DataFrame:
        """snapshot_id, committed_at and path (a directory below ``data``) of every snapshot."""
        ids = self.snapshot_ids(spark)
        if not ids:
            return spark.createDataFrame([], MANIFEST).select(*SNAPSHOT_COLUMNS)
        rows = spark.read.schema(MANIFEST).json([self._manifest_file(i) for i in ids])
        return rows.where("path IS NOT NULL").select(*SNAPSHOT_COLUMNS)

    def read(self, spark: SparkSession, snapshot_id: int | None = None) -> DataFrame:
        """The newest version, or an older one that is still kept."""
        schema, directories = self._contents(spark, snapshot_id)
        return self._read_directories(spark, schema, directories)

    def files(self, spark: SparkSession, name: str = "table") -> DataFrame:
        """Listing of the data files of the newest version."""
        _, directories = self._contents(spark)
        return self._listing(spark, directories, name)

    # ---- writing

    def write(self, df: DataFrame, mode: str = "overwrite", gate: Gate | None = None) -> WriteResult:
        """Write, audit, publish. A failed audit leaves the published version as it is.

        The audit's counts are observed in the very tasks that write the files, after the
        last shuffle, where Spark counts each task once even if it runs again.
        """
        spark, started, gate = df.sparkSession, time.time(), gate or Gate()
        version, previous = self._check_mode(spark, df, mode)
        load = f"load={uuid.uuid4().hex}"
        observation = Observation()
        staged = clustered(df, self.partition_by).observe(observation, *observed_measures(gate))
        self._write_load(staged, load)
        observed = observation.get
        try:
            directories, target_count, size = self._inspect(spark, df.schema, load)
            if target_count != observed["row_count"]:
                raise RuntimeError(
                    f"Row count mismatch: source={observed['row_count']}, target={target_count}"
                )
            written = self._read_directories(spark, df.schema, directories)
            score = check(spark, self.root, gate, observed, written)
            snapshot_id = self._publish(df, mode, directories, version, previous)
        except Exception:
            fs.delete(spark, self._data(load))
            raise
        return WriteResult(
            target=self.root,
            rows=observed["row_count"],
            target_count=target_count,
            bytes_written=size,
            duration_seconds=time.time() - started,
            quality_score=score,
            snapshot_id=snapshot_id,
        )

    # ---- maintenance

    def compact(
        self, spark: SparkSession, target_bytes: int = TARGET_FILE_BYTES, verify: str = "content"
    ) -> int:
        """Merge small files per partition into files of about ``target_bytes``.

        Files of ``SMALL_SHARE`` of that size and more stay as they are, as do partitions that
        would not get fewer files. No shuffle: a partition's scan splits are merged to as many
        tasks as it needs files, and the partitions of one job run side by side. A directory of
        small files only is read by its name; of mixed ones the files are named. Returns the
        files saved.
        """
        self._check_partitions(spark)
        version = self._version(spark)
        schema, directories = self._contents(spark, version)
        small = F.col("length") < F.lit(SMALL_SHARE * target_bytes)
        entries = self._entries(spark, version, directories).groupBy("partition", "entry").agg(
            F.count_if(small).alias("n_small"),
            F.sum(F.when(small, F.col("length"))).alias("small_bytes"),
            F.collect_list(F.when(small, F.col("file"))).alias("small"),
            F.collect_list(F.when(~small, F.col("file"))).alias("full"),
        )
        merged = F.when(F.size("full") > 0, F.col("small")).otherwise(F.array("entry"))
        groups = (
            entries.where("n_small > 0")
            .groupBy("partition")
            .agg(
                F.sum("n_small").alias("file_count"),
                F.greatest(F.lit(1), F.ceil(F.sum("small_bytes") / F.lit(target_bytes))).cast("int").alias("wanted"),
                F.collect_list("entry").alias("entries"),
                F.flatten(F.collect_list(merged)).alias("merged"),
                F.flatten(F.collect_list("full")).alias("full"),
            )
            .where("file_count > wanted")
            .orderBy("partition")
            .collect()
        )
        if not groups:
            return 0
        load = f"load={uuid.uuid4().hex}"
        for at in range(0, len(groups), GROUPS_PER_JOB):
            parts = [
                self._read_paths(spark, schema, sorted(g["merged"])).coalesce(g["wanted"])
                for g in groups[at : at + GROUPS_PER_JOB]
            ]
            # A task's rows are of one partition: its file needs no sort by partition.
            with _unsorted_partitions(spark):
                self._write_load(reduce(DataFrame.unionAll, parts), load, "append")
        new = self._inspect(spark, schema, load)[0]
        before = self._read_paths(spark, schema, sorted(p for g in groups for p in g["merged"]))
        self._verify(spark, schema, before, new, verify, load)
        replaced = {e for g in groups for e in g["entries"]}
        carried = {d: n for d, n in directories.items() if d not in replaced}
        carried |= {f: 0 for g in groups for f in g["full"]}
        self._commit(spark, schema, carried | new, version)
        return sum(g["file_count"] for g in groups) - self._listing(spark, new).count()

    def rewrite_sorted(
        self,
        spark: SparkSession,
        columns: Sequence[str],
        target_bytes: int = TARGET_FILE_BYTES,
        verify: str = "content",
        zorder: bool = False,
    ) -> int:
        """Rewrite the table in the order of some columns, for min/max pruning.

        With ``zorder`` the columns are interleaved, so that files are narrow in all of them.

        Rows are range-partitioned by table partition and sort columns. The row's position
        ends the range key, so one value that holds most rows is still cut into many files.
        A file is sorted by one task, so it takes at most ``SORT_VALUES`` values, about, even where
        these take less than ``target_bytes``. Returns the number of files written.
        """
        self._check_partitions(spark)
        version = self._version(spark)
        schema, directories = self._contents(spark, version)
        if not directories:
            return 0
        rows, own = self._read_directories(spark, schema, directories), list(self.partition_by)
        values = rows.count() * len(schema)
        files = max(1, -(-self._bytes(spark, directories) // target_bytes), -(-values // SORT_VALUES))
        columns = [c for c in columns if c not in own]
        key = own + columns
        if zorder and columns:
            rows, key = with_zorder(rows, columns, "_z"), [*own, "_z"]
        ordered = (
            rows.withColumn("_position", F.monotonically_increasing_id())
            .repartitionByRange(files, *key, "_position")
            .sortWithinPartitions(*key)
            .select(*schema.fieldNames())
        )
        load = f"load={uuid.uuid4().hex}"
        self._write_load(ordered, load)
        new = self._inspect(spark, schema, load)[0]
        before = self._read_directories(spark, schema, directories)
        self._verify(spark, schema, before, new, verify, load)
        self._commit(spark, schema, new, version)
        return self._listing(spark, new).count()

    def expire_snapshots(self, spark: SparkSession, retain_last: int = 30) -> list[str]:
        """Forget all but the newest snapshots; delete what only the forgotten ones used."""
        # By number alone: the clocks of the drivers that committed may differ.
        manifest, order = self.manifest(spark), {"newest_by": ["snapshot_id"]}
        doomed = expired_files(manifest, retain_last, **order)
        expired = expired_snapshots(manifest, retain_last, **order)
        in_use = manifest.join(expired, "snapshot_id", "left_anti").select("path").distinct()
        # Directories of which a kept version takes some files lose the others only.
        shared = doomed.join(in_use.select(_parent("path").alias("path")), "path", "left_semi")
        partly = [r["path"] for r in shared.collect()]
        paths = [r["path"] for r in doomed.join(shared, "path", "left_anti").collect()]
        if partly:
            listing = file_inventory(spark, {"data": [self._data(p) for p in partly]})
            files = listing.select(self._relative(spark).alias("path"))
            paths += [r["path"] for r in files.join(in_use, "path", "left_anti").distinct().collect()]
        ids = [r["snapshot_id"] for r in expired.select("snapshot_id").distinct().collect()]
        # Forgotten first, then deleted: no reader finds a version with files missing.
        fs.delete_all(spark, [self._manifest_file(i) for i in ids])
        fs.delete_all(spark, [self._data(p) for p in paths])
        return sorted(paths)

    def orphan_files(self, spark: SparkSession, older_than: Column | None = None) -> DataFrame:
        """Data files no snapshot lists, such as those of a failed write, finished or not.

        Younger ones than ``older_than`` (by default three days) may belong to a write that is
        still under way.
        """
        if older_than is None:
            older_than = F.current_timestamp() - F.expr("INTERVAL 3 DAYS")
        listing = file_inventory(spark, {"data": self._data()})
        # What the tasks of a write that broke off left; listings pass over such folders.
        unfinished = self._data("*/_temporary/*/*")
        if fs.matches(spark, unfinished):
            listing = listing.unionAll(file_inventory(spark, {"data": unfinished}))
        manifest = self.manifest(spark)
        file = self._relative(spark)
        listing = listing.select(
            F.col("path").alias("uri"), file.alias("file"), _parent(file).alias("path"), "length", "modificationTime"
        )
        # A version lists a file by its directory or by its own name.
        unlisted = orphan_files(listing, manifest, older_than).withColumn("path", F.col("file"))
        return orphan_files(unlisted, manifest).select(F.col("uri").alias("path"), "length", "modificationTime")

    def remove_orphan_files(
        self, spark: SparkSession, older_than: Column | None = None, dry_run: bool = True
    ) -> list[str]:
        """Delete the orphans; by default only name them."""
        paths = [r["path"] for r in self.orphan_files(spark, older_than).toLocalIterator()]
        if not dry_run:
            fs.delete_all(spark, paths)
        return sorted(paths)

    # ---- inside

    def _data(self, relative: str = "") -> str:
        return f"{self.root}/data/{relative}".rstrip("/")

    def _manifest_file(self, snapshot_id: int) -> str:
        return f"{self.root}/manifest/{snapshot_id:08d}.json"

    def _contents(
        self, spark: SparkSession, snapshot_id: int | None = None
    ) -> tuple[T.StructType, Directories]:
        """Schema and directories of a version. As many directories as partition writes."""
        ids = self.snapshot_ids(spark)
        if snapshot_id is None:
            snapshot_id = ids[-1] if ids else None
        if snapshot_id not in ids:
            raise FileNotFoundError(f"{self.root}: no snapshot {snapshot_id}")
        rows = spark.read.schema(MANIFEST).json(self._manifest_file(snapshot_id)).collect()
        schema = next(T._parse_datatype_json_string(r["schema"]) for r in rows if r["schema"])
        return schema, {r["path"]: r["of_load"] for r in rows if r["path"]}

    def _paths(self, directories: Directories) -> list[str]:
        """What to hand to a reader: a load that is there in full by its root alone."""
        loads: dict[str, list[str]] = {}
        for d in directories:
            loads.setdefault(d.partition("/")[0], []).append(d)
        whole = {load for load, inside in loads.items() if all(directories[d] == len(inside) for d in inside)}
        return sorted(d for load, inside in loads.items() for d in ([load] if load in whole else inside))

    def _read_directories(
        self, spark: SparkSession, schema: T.StructType, directories: Directories
    ) -> DataFrame:
        return self._read_paths(spark, schema, self._paths(directories))

    def _read_paths(self, spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema).option("basePath", self._data())
        return reader.parquet(*[self._data(p) for p in paths]).select(*schema.fieldNames())

    def _listing(self, spark: SparkSession, directories: Directories, name: str = "table") -> DataFrame:
        if not directories:
            return file_inventory(spark, {name: f"{self.root}/manifest"}).where(F.lit(False))
        return file_inventory(spark, {name: [self._data(p) for p in self._paths(directories)]})

    def _entries(self, spark: SparkSession, version: int, directories: Directories) -> DataFrame:
        """The listing of a version, with ``file`` (below ``data``) and the ``entry`` that brings it in."""
        own = self.manifest(spark).where(F.col("snapshot_id") == version)
        listing = self._listing(spark, directories).withColumn("file", self._relative(spark)).drop("path")
        named = listing.join(own.select("path"), F.col("file") == F.col("path"), "left")
        return named.withColumn("entry", F.coalesce("path", _parent("file"))).drop("path")

    def _relative(self, spark: SparkSession) -> Column:
        """Path of a listed file, below ``data``."""
        root = fs.qualified(spark, self._data())
        return F.substring("path", len(root) + 2, 1 << 20)

    def _version(self, spark: SparkSession) -> int:
        """Number of the newest version, 0 when there is none."""
        return max(self.snapshot_ids(spark), default=0)

    def _check_mode(self, spark: SparkSession, df: DataFrame, mode: str) -> tuple[int, Directories]:
        if mode not in ("create", "overwrite", "append"):
            raise ValueError(f"unknown mode {mode!r}; known: create, overwrite, append")
        version = self._version(spark)
        if not version:
            return 0, {}
        if mode == "create":
            raise FileExistsError(f"{self.root} exists")
        schema, directories = self._contents(spark, version)
        if mode == "append":
            self._check_partitions(spark)
            if _shape(schema) != _shape(df.schema):
                raise ValueError(f"{self.root}: appended rows have another schema")
        return version, directories

    def _stored_partitions(self, spark: SparkSession) -> tuple[str, ...]:
        newest = self._manifest_file(self._version(spark))
        return tuple(spark.read.schema(MANIFEST).json(newest).where("schema IS NOT NULL").first()["partition_by"])

    def _check_partitions(self, spark: SparkSession) -> None:
        if self.snapshot_ids(spark) and self._stored_partitions(spark) != tuple(self.partition_by):
            raise ValueError(f"{self.root} is partitioned by {self._stored_partitions(spark)}")

    def _write_load(self, df: DataFrame, load: str, mode: str = "errorifexists") -> None:
        writer = df.write.mode(mode)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(self._data(load))

    def _bytes(self, spark: SparkSession, directories: Directories) -> int:
        return self._listing(spark, directories).agg(F.sum("length")).first()[0] or 0

    def _inspect(
        self, spark: SparkSession, schema: T.StructType, load: str
    ) -> tuple[Directories, int, int]:
        """Directories, rows and bytes of a load, read back from its files (no data column is)."""
        # As readers see it, a directory of a partition column may begin with an underscore.
        names = fs.child_names(spark, self._data(load))
        if not [n for n in names if "=" in n or not n.startswith(("_", "."))]:
            return {}, 0, 0
        reader = spark.read.schema(schema).option("basePath", self._data())
        found = (
            reader.parquet(self._data(load))
            .select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"))
            .groupBy("uri", "size")
            .agg(F.count(F.lit(1)).alias("n"))
            # Here paths come URI-encoded, where listings and readers take them as they are.
            .withColumn("path", F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))))
            .groupBy(_parent(self._relative(spark)).alias("directory"))
            .agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
            .collect()
        )
        directories = {d: len(found) for d in sorted(r["directory"] for r in found)}
        return directories, sum(r["n"] for r in found), sum(r["size"] for r in found)

    def _verify(self, spark, schema, before: DataFrame, new: Directories, how: str, load: str) -> None:
        after = self._read_directories(spark, schema, new)
        result = (reconcile if how == "content" else reconcile_counts)(before, after).first()
        if not result["passed"]:
            fs.delete(spark, self._data(load))
            raise RuntimeError(f"{self.root}: rewrite changed the rows: {result.asDict()}")

    def _publish(
        self, df: DataFrame, mode: str, directories: Directories, version: int, previous: Directories
    ) -> int:
        """Commit a write. Appends commute: one that lost the race follows the version that won."""
        spark = df.sparkSession
        while True:
            keep = previous if mode == "append" else {}
            try:
                return self._commit(spark, df.schema, keep | directories, version)
            except Exception:
                taken = self._version(spark) > version
                if taken and directories and directories.keys() <= self._contents(spark)[1].keys():
                    return version + 1  # the rename went through before the error came
                if mode != "append" or not taken:
                    raise
                version, previous = self._check_mode(spark, df, mode)

    def _commit(self, spark: SparkSession, schema: T.StructType, directories: Directories, after: int) -> int:
        """Publish the version that follows ``after``, the one this write started from."""
        snapshot_id = after + 1
        version = {"snapshot_id": snapshot_id, "committed_at": datetime.now(timezone.utc).isoformat()}
        rows = [{"schema": schema.json(), "partition_by": list(self.partition_by)}]
        rows += [{"path": d, "of_load": n} for d, n in sorted(directories.items())]
        text = "".join(json.dumps(version | row) + "\n" for row in rows)
        fs.write_new(spark, self._manifest_file(snapshot_id), text)
        return snapshot_id


class _unsorted_partitions:
    """Partitioned writes inside keep a writer open per partition, up to a few, instead of sorting a task's rows."""

    NAME, WRITERS = "spark.sql.maxConcurrentOutputFileWriters", "8"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, self.WRITERS)

    def __exit__(self, *error) -> None:
        self.conf.unset(self.NAME) if self.before is None else self.conf.set(self.NAME, self.before)


def _parent(path: Column | str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
