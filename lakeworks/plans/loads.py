"""Deduplication across loads: an append that keeps the first row of every key, over all loads.

Beside the rows lies a blocked Bloom filter of their keys, one table of partial blocks per load,
merged by ``bit_or``. A load's rows that the filter has not seen are new and skip the join with what
is stored; the few it may have seen are compared exactly, with the stored keys that a
filter of *them* lets through. So of the stored table one column set is scanned and next to
nothing of it is shuffled; of a load that is there already, the keys alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.dedup import dedup
from lakeworks.sources import fs
from lakeworks.sources.scratch import new_folder

#: 64-bit words of a block; two bits in each are set for a key.
WORDS = ("w0", "w1", "w2", "w3")
#: Blocks of a filter: 4 MB, 1 % false positives at some 3 million keys.
BLOCKS = 1 << 17
#: Filters of at most so many blocks are sent to all executors; larger ones are joined by block.
BROADCAST_BLOCKS = 1 << 18


def _block(keys: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block")


def _masks(keys: Sequence[str]) -> list[Column]:
    """The two bits of each word, from twelve bits of a second hash."""
    draw = F.xxhash64(F.lit("bits"), *keys)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(draw, at).bitwiseAND(63).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)).alias(w) for i, w in enumerate(WORDS)]


def bloom_filter(rows: DataFrame, keys: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """``block`` and its words: at most ``blocks`` rows, combined per task before the shuffle."""
    return merged(rows.select(_block(keys, blocks), *_masks(keys)))


def merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def flagged(rows: DataFrame, keys: Sequence[str], bloom: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` as the struct ``own``, and ``possible``: false only where no row of the filter has these keys."""
    side = bloom.select("block", F.struct(*WORDS).alias("seen"))
    if blocks <= BROADCAST_BLOCKS:
        side = F.broadcast(side)
    masks = F.struct(*_masks(keys)).alias("mask")
    joined = rows.select(F.struct("*").alias("own"), _block(keys, blocks), masks).join(side, "block", "left")
    hit = [F.col(f"seen.{w}").bitwiseAND(F.col(f"mask.{w}")) == F.col(f"mask.{w}") for w in WORDS]
    return joined.select("own", F.coalesce(reduce(and_, hit), F.lit(False)).alias("possible"))


@dataclass(frozen=True)
class UniqueLoads:
    """Rows with one row per key over all loads, below ``root``.

    Of equal keys in different loads the row added first stays; within a load the greatest by
    ``newest_by``, then by all other columns. Null keys are equal to each other. A load that is added again
    replaces itself. All loads have the same columns and ``blocks``.
    """

    root: str
    keys: Sequence[str]
    newest_by: Sequence[str] = ()
    blocks: int = BLOCKS

    def add(self, load: DataFrame, name: str) -> int:
        """Append what is new in ``load``; the number of rows that were."""
        spark = load.sparkSession
        others = self._stored(spark, name)
        if others is not None:
            bloom = merged(spark.read.parquet(f"{self.root}/filter").where(F.col("load").cast("string") != name))
            path = new_folder(spark, "unique-load")
            flagged(load, self.keys, bloom, self.blocks).write.parquet(path)
            staged = spark.read.parquet(path)
            suspects = staged.where("possible").select("own.*")
            load = staged.where(~F.col("possible")).select("own.*").unionByName(self._unknown(suspects, others))
        # Whether a row is new hangs on its key alone: only what is new is shuffled whole.
        fresh = dedup(load, self.keys, self.newest_by)
        path = new_folder(spark, "unique-rows")
        fresh.write.parquet(path)
        fresh = spark.read.schema(load.schema).parquet(path)
        # The filter first, and never with fewer bits: a job that ends in between leaves bits too many only.
        bloom_filter(fresh, self.keys, self.blocks).write.mode("append").parquet(f"{self.root}/filter/load={name}")
        fresh.write.mode("overwrite").parquet(f"{self.root}/rows/load={name}")
        return fresh.count()

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows, and the ``load`` that brought them."""
        return spark.read.parquet(f"{self.root}/rows")

    def _stored(self, spark: SparkSession, but: str) -> DataFrame | None:
        names = {n.removeprefix("load=") for n in fs.child_names(spark, f"{self.root}/rows")} - {but}
        if not names:
            return None
        return self.read(spark).where(F.col("load").cast("string") != but).drop("load")

    def _unknown(self, suspects: DataFrame, stored: DataFrame) -> DataFrame:
        """The suspects whose keys are not stored, exactly."""
        bloom = bloom_filter(suspects, self.keys, self.blocks)
        known = flagged(stored.select(*self.keys), self.keys, bloom, self.blocks).where("possible").select("own.*")
        known = known.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)])
        # Found by keys alone and stored, so that few are joined to their rows without a shuffle of these.
        new = self._joined(suspects.select(*self.keys).distinct(), known, "left_anti")
        path = new_folder(suspects.sparkSession, "unique-keys")
        new.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]).write.parquet(path)
        return self._joined(suspects, suspects.sparkSession.read.parquet(path), "left_semi")

    def _joined(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Rows whose keys are, or are not, among ``keys``, there numbered."""
        own = rows.select(F.struct("*").alias("own"))
        same = [F.col("own")[k].eqNullSafe(keys[f"_{i}"]) for i, k in enumerate(self.keys)]
        return own.join(keys, reduce(and_, same), how).select("own.*")
