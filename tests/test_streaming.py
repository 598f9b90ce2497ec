from __future__ import annotations

import json

import pytest
from frames import BASE, raw, rows
from pyspark.sql import functions as F

from lakeworks.operators.cleanse import bronze_to_silver, valid_rows
from lakeworks.schemas import RAW
from lakeworks.sources.scratch import new_folder
from lakeworks.streaming.append import append_stream, parse_values, read_stream, silver_stream
from lakeworks.streaming.hybrid import backfill_then_stream, read_hybrid


@pytest.fixture
def root(spark):
    return new_folder(spark, "stream")


def arrive(df, root):
    df.coalesce(1).write.mode("append").json(f"{root}/in")


def drain(rows_, root, **where):
    append_stream(rows_, f"{root}/checkpoint", available_now=True, **(where or {"path": f"{root}/out"})).awaitTermination()


def test_append_goes_on_from_its_checkpoint(spark, root):
    source = lambda: valid_rows(read_stream(spark, "json", RAW, f"{root}/in"))
    arrive(raw(spark, {}, {"transaction_id": "t2", "status": "FAILED"}), root)
    drain(source(), root)
    arrive(raw(spark, {"transaction_id": "t3"}), root)
    drain(source(), root)
    drain(source(), root)
    assert rows(spark.read.parquet(f"{root}/out"), "transaction_id") == [("t1",), ("t3",)]


def test_append_to_a_table(spark, root):
    name = "streamed_" + root[-8:]
    arrive(raw(spark, {}), root)
    drain(read_stream(spark, "json", RAW, f"{root}/in"), root, table=name)
    assert spark.table(name).count() == 1


def test_target_must_be_one(spark, root):
    arrive(raw(spark, {}), root)
    stream = read_stream(spark, "json", RAW, f"{root}/in")
    with pytest.raises(ValueError, match="either"):
        append_stream(stream, "c")


def test_kafka_values(spark):
    df = spark.createDataFrame([(bytearray(json.dumps(BASE), "utf-8"),), (bytearray(b"{bad"),)], "value binary")
    got = rows(parse_values(df), "transaction_id", "amount")
    assert got == [("t1", 10.0), (None, None)]


def test_silver_stream_agrees_with_batch_on_exact_copies(spark, root):
    first = raw(spark, {}, {"transaction_id": "t2"}, {"transaction_id": "t2"}, {"transaction_id": "t4", "amount": 0.0})
    arrive(first, root)
    stream = lambda: silver_stream(read_stream(spark, "json", RAW, f"{root}/in"))
    drain(stream(), root)
    arrive(raw(spark, {}, {"transaction_id": "t3", "transaction_ts": "2024-01-01T00:30:00"}), root)
    drain(stream(), root)
    everything = spark.read.schema(RAW).json(f"{root}/in")
    assert rows(spark.read.parquet(f"{root}/out")) == rows(bronze_to_silver(everything))


def test_silver_stream_keeps_rows_without_time(spark, root):
    arrive(raw(spark, {}, {"transaction_id": "t2", "transaction_ts": "nope"}), root)
    drain(silver_stream(read_stream(spark, "json", RAW, f"{root}/in")), root)
    assert rows(spark.read.parquet(f"{root}/out"), "transaction_id") == [("t1",), ("t2",)]


def numbered(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))


def test_nothing_is_lost_or_doubled_at_the_hand_over(spark, root):
    schema = numbered(spark, 0, 1).schema
    arrive(numbered(spark, 0, 10), root)
    # Rows 10 to 14 arrive after the backfill was read, 15 to 19 once the stream has run.
    backfill = spark.read.schema(schema).json(f"{root}/in").where("seq < 10")
    arrive(numbered(spark, 10, 15), root)

    def run(limit):
        hybrid = backfill_then_stream(
            backfill,
            read_stream(spark, "json", schema, f"{root}/in"),
            "seq",
            f"{root}/out",
            f"{root}/checkpoint",
            transform=lambda df: df.where(f"v < {limit}"),
            available_now=True,
        )
        hybrid.query.awaitTermination()
        return hybrid.high_water_mark

    assert run(1000) == "9"
    assert rows(read_hybrid(spark, f"{root}/out"), "seq") == rows(numbered(spark, 0, 15), "seq")
    arrive(numbered(spark, 15, 20), root)
    assert run(1000) == "9"
    assert rows(read_hybrid(spark, f"{root}/out"), "seq") == rows(numbered(spark, 0, 20), "seq")


def test_empty_backfill_streams_everything(spark, root):
    schema = numbered(spark, 0, 1).schema
    arrive(numbered(spark, 0, 4), root)
    stream = read_stream(spark, "json", schema, f"{root}/in")
    empty = spark.createDataFrame([], schema)
    backfill_then_stream(
        empty, stream, "seq", f"{root}/out", f"{root}/checkpoint", available_now=True
    ).query.awaitTermination()
    assert read_hybrid(spark, f"{root}/out").count() == 4


def test_slower_partitions_and_rows_without_position_are_kept(spark, tmp_path):
    schema = "part int, position long, name string"
    backfill = spark.createDataFrame([(0, 10, "a"), (1, 2, "b")], schema)
    arriving = [(0, 10, "a"), (0, 11, "c"), (1, 2, "b"), (1, 3, "d"), (2, 1, "e"), (0, None, "f")]
    spark.createDataFrame(arriving, schema).write.json(str(tmp_path / "in"))
    stream = read_stream(spark, "json", backfill.schema, str(tmp_path / "in"), per_batch=1)
    handed = backfill_then_stream(
        backfill,
        stream,
        "position",
        str(tmp_path / "out"),
        str(tmp_path / "checkpoint"),
        available_now=True,
        partition="part",
    )
    handed.query.awaitTermination()
    assert handed.high_water_mark == {"0": "10", "1": "2"}
    assert sorted(r.name for r in read_hybrid(spark, str(tmp_path / "out")).collect()) == list("abcdef")


def test_messages_keep_their_place_and_bad_ones_their_text(spark):
    df = spark.createDataFrame(
        [('{"transaction_id": "x"}', 3, 7), ("broken", 4, 8)], "value string, partition int, offset long"
    )
    good, bad = parse_values(df).orderBy("kafka_offset").collect()
    assert (good.transaction_id, good.kafka_partition, good._corrupt_record) == ("x", 3, None)
    assert (bad.transaction_id, bad.kafka_offset, bad._corrupt_record) == (None, 8, "broken")
