"""Keyed deduplication with a decided survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedup(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str] = ()) -> DataFrame:
    """Keep one row per key: the greatest by ``newest_by``, then by all other columns.

    The order covers every column (but maps, which have none), so the survivor does not depend on how the input was
    split or in which order it arrived. Null keys form one group. No keys: nothing to do.

    Spark turns ``row_number() = 1`` into a group limit that also runs before the shuffle:
    each map task sends at most one row per key, so a key that holds a third of all rows
    reaches its reducer as one row per map task.
    """
    if not keys:
        return df
    first = [c for c in newest_by if c not in keys]
    rest = [
        f.name
        for f in df.schema.fields
        if f.name not in {*keys, *first} and not isinstance(f.dataType, T.MapType)
    ]
    order = [F.col(c).desc_nulls_last() for c in [*first, *rest]] or [F.lit(1)]
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", newest).where("_rn = 1").drop("_rn")
