"""Latest rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Spark's default of spark.sql.optimizer.windowGroupLimitThreshold, and parts of a hot group beyond it.
GROUP_LIMIT = 1000
PARTS = 64


def latest_per_group(
    df: DataFrame, by: Sequence[str], k: int, newest_by: Sequence[str], rank: str = "rn"
) -> DataFrame:
    """The last ``k`` rows of every group, numbered from the newest.

    The row-number filter becomes a group limit before the shuffle: every map task sends at
    most ``k`` rows of a group, however large the group is. Spark does so up to
    ``GROUP_LIMIT`` rows; beyond, the last ``k`` of each of ``PARTS`` parts of a group are taken first.
    """
    order = [F.col(c).desc_nulls_last() for c in newest_by]
    if k > GROUP_LIMIT:
        parts = df.withColumn("_part", F.spark_partition_id() % PARTS)
        within = Window.partitionBy(*by, "_part").orderBy(*order)
        df = parts.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= k).drop("_part", "_rank")
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return numbered.where(F.col(rank) <= k)
