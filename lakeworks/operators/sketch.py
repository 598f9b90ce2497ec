"""Quantiles of file sizes from sketches that are kept, added and subtracted instead of rescanned.

A sketch counts sizes in buckets that grow by a constant factor, so a quantile read off it is
within a relative error of the exact one, whatever the sizes. Counts add: sketches of listings taken at
different times or places merge by a sum, and the sketch of deleted files is subtracted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a quantile.
ERROR = 0.01


def growth(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket(size: Column, error: float = ERROR) -> Column:
    """The number of a size's bucket; empty files have one of their own. At most some 2,200 at 1 %."""
    return F.when(size >= 1, F.ceil(F.log(size) / math.log(growth(error)))).otherwise(-1).cast("int")


def size_sketch(files: DataFrame, by: Sequence[str] = ("table",), error: float = ERROR) -> DataFrame:
    """``by``, ``bucket``, ``files`` and ``bytes`` of a listing (``length``); unknown lengths are left out."""
    return (
        files.where(F.col("length").isNotNull())
        .groupBy(*by, bucket(F.col("length"), error).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def merge_sketches(
    added: Sequence[DataFrame], removed: Sequence[DataFrame] = (), by: Sequence[str] = ("table",)
) -> DataFrame:
    """One sketch of all the files in ``added`` but those in ``removed``; coarser where ``by`` is shorter."""
    minus = [s.withColumns({"files": -F.col("files"), "bytes": -F.col("bytes")}) for s in removed]
    every = reduce(DataFrame.unionByName, [*added, *minus])
    total = every.groupBy(*by, "bucket").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return total.where(F.col("files") > 0)


def size_quantiles(
    sketch: DataFrame, quantiles: Sequence[float], by: Sequence[str] = ("table",), error: float = ERROR
) -> DataFrame:
    """``by``, ``quantile``, ``file_count``, ``total_bytes`` and ``bytes``, within ``error`` of the exact quantile.

    The quantile q of n files is the size at rank ceil(q n), as of ``percentile_disc``.
    """
    whole = Window.partitionBy(*by)
    ranked = sketch.withColumns(
        {
            "upto": F.sum("files").over(whole.orderBy("bucket")),
            "file_count": F.sum("files").over(whole),
            "total_bytes": F.sum("bytes").over(whole),
        }
    )
    wanted = ranked.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("file_count")))
    factor = growth(error)
    size = F.when(F.col("bucket") >= 0, 2 * F.pow(F.lit(factor), F.col("bucket")) / (factor + 1)).otherwise(0)
    return (
        wanted.where((F.col("upto") >= rank) & (F.col("upto") - F.col("files") < rank))
        .select(*by, "quantile", "file_count", "total_bytes", size.alias("bytes"))
    )
