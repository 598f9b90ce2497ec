"""The newest row per key on a stream, by keyed state.

Spark keeps one row per key, or its rank, in RocksDB. A key is
passed on whenever a batch holds a newer row than that; so the row of the last epoch in which
a key occurs is its newest, and that row is the one a batch deduplication keeps. The state may have a
time to live: a key under which nothing has arrived for a while is forgotten. That takes Python state,
which is handed the rows of one key at a time; without it all is a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeworks.operators.cleanse import NEWEST_FIRST, valid_rows
from lakeworks.operators.topk import latest_per_group

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 24 * 3600 * 1000


class Newest(StatefulProcessor):
    """Passes on the greatest row of a key by its rank columns, nulls last; keeps its rank."""

    def __init__(self, columns: Sequence[str], rank: T.StructType, keep_ms: int):
        self.columns, self.schema, self.keep_ms = list(columns), rank, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept, newest = self.newest.get(), None
        rank = kept and _comparable(kept)
        for row in rows:
            values = tuple(row[c] for c in self.schema.fieldNames())
            own = _comparable(values)
            if kept is None or own > rank:
                kept, rank, newest = values, own, row
        self.newest.update(tuple(kept))  # also where it stays the same: its time begins anew
        if newest is not None:
            yield Row(**{c: newest[c] for c in self.columns})

    def close(self) -> None:
        pass


def _comparable(values: Sequence) -> tuple:
    return tuple((v is not None, v) for v in values)


def _rank_columns(schema: T.StructType, order: Sequence[str]) -> dict[str, Column]:
    """The order as plain values, times and dates as numbers: state and rows then hold the same ones."""
    plain = {T.TimestampType: F.unix_micros, T.DateType: F.unix_date}
    ranked = [*order, *[f.name for f in schema.fields if f.name not in order]]
    return {f"_rank_{i}": plain.get(type(schema[c].dataType), lambda x: x)(F.col(c)) for i, c in enumerate(ranked)}


def newest_stream(
    rows: DataFrame, keys: Sequence[str], newest_by: Sequence[str] = (), keep_ms: int | None = DAY_MS
) -> DataFrame:
    """Rows of a stream that are newer than all that came before under their keys.

    Newer means greater by ``newest_by``, then by the other columns, as in ``operators.dedup``; the
    order must be one of plain values (no maps, arrays or structs). Null keys are a key. Within a
    batch a key gives at most one row. ``keep_ms`` without an arrival forgets a key (``None``: never):
    an older copy that comes even later would be passed on again. Start the stream in update mode and
    within ``keyed_state``. Keys that are never forgotten cost a fraction of the time.
    """
    if keep_ms is None:
        return _never_forgetting(rows, keys, [c for c in newest_by if c not in keys])
    columns, schema = rows.columns, rows.schema
    ranked = rows.withColumns(_rank_columns(schema, [c for c in newest_by if c not in keys]))
    rank = T.StructType([f for f in ranked.schema.fields if f.name not in columns])
    return ranked.groupBy(*keys).transformWithState(Newest(columns, rank, keep_ms), schema, "update", "processingTime")


def _never_forgetting(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row per key, wherever it came with the batch at hand.

    Of equal rows the first to arrive counts: its time of arrival, which is one for a whole batch and
    the same when that runs again, tells whether the row is news.
    """
    columns = rows.columns
    ranked = [*order, *[c for c in columns if c not in {*order, *keys}]]
    waiting = -F.unix_micros(F.current_timestamp())
    greatest = F.max(F.struct(*ranked, "_waiting")).alias("_newest")
    newest = rows.withColumn("_waiting", waiting).groupBy(*keys).agg(greatest)
    newest = newest.where(F.col("_newest._waiting") == waiting)
    return newest.select(*[F.col(c) if c in keys else F.col("_newest")[c].alias(c) for c in columns])


def silver_newest_stream(raw: DataFrame, keep_ms: int | None = DAY_MS) -> DataFrame:
    """The silver rules on a stream, the newest row per transaction id."""
    return newest_stream(valid_rows(raw), ["transaction_id"], NEWEST_FIRST, keep_ms)


def of_last_epoch(published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest rows out of all published changes: per key, the one of its last epoch."""
    return latest_per_group(published, keys, 1, ["epoch"], "_rn").drop("epoch", "_rn")


class keyed_state:
    """Queries started inside keep their state in RocksDB, and run no batches without data.

    State with a time to live would ask for another batch without end, and a stream that works off
    what is there would never stop.
    """

    SETTINGS = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = {name: self.conf.get(name, None) for name in self.SETTINGS}
        for name, value in self.SETTINGS.items():
            self.conf.set(name, value)

    def __exit__(self, *error) -> None:
        for name, value in self.before.items():
            self.conf.unset(name) if value is None else self.conf.set(name, value)
