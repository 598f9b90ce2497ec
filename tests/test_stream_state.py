from __future__ import annotations

import pytest
from frames import raw, rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lakeworks.operators.cleanse import bronze_to_silver
from lakeworks.operators.quality import DataQualityError, positive_amount
from lakeworks.plans.runlog import read_runs
from lakeworks.schemas import RAW
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate
from lakeworks.sources.scratch import new_folder
from lakeworks.streaming.append import read_stream
from lakeworks.streaming.newest import PROVIDER, keyed_state, newest_stream, of_last_epoch, silver_newest_stream
from lakeworks.streaming.publish import epochs, publish_epoch, publish_stream, read_published


@pytest.fixture
def root(spark):
    return new_folder(spark, "state")


def arrive(df, root):
    df.coalesce(1).write.mode("append").json(f"{root}/in")


def test_newest_row_wins_however_late_it_comes(spark, root):
    versions = [
        raw(spark, {"amount": 5.0}, {"transaction_id": "t2"}, {"transaction_id": None}),
        raw(spark, {"amount": 7.0}, {"transaction_id": "t2", "transaction_ts": "2023-01-01T00:00:00", "amount": 99.0}),
        raw(spark, {"amount": 6.0}, {"transaction_id": "t3", "status": "FAILED"}, {"transaction_id": "t3"}),
        raw(spark, {"amount": 7.0}, {"amount": 7.0, "merchant_name": None}, {"transaction_id": "t2", "merchant_name": "Z"}),
    ]
    stream = None
    for part in versions:
        arrive(part, root)
        stream = silver_newest_stream(read_stream(spark, "json", RAW, f"{root}/in"))
        with keyed_state(spark):
            publish_stream(stream, f"{root}/t", f"{root}/c", output_mode="update", available_now=True).awaitTermination()
    assert spark.conf.get(PROVIDER, None) != "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    published = read_published(spark, f"{root}/t", stream.schema)
    everything = versions[0]
    for part in versions[1:]:
        everything = everything.unionAll(part)
    assert rows(of_last_epoch(published, ["transaction_id"])) == rows(bronze_to_silver(everything))
    # t1 was passed on twice: first and by 7.0; 6.0 and the equal copies are no news.
    assert rows(published.where("transaction_id = 't1'"), "epoch", "amount") == [
        (0, published.first()["amount"].__class__("5.00")),
        (1, published.first()["amount"].__class__("7.00")),
    ]


def test_newest_by_plain_columns_without_forgetting(spark, root):
    schema = "k string, at timestamp, v int"
    for batch in (["a 1 1", "b 5 1"], ["a 3 2", "b 4 9"], ["a 3 1", "c 1 1"]):
        made = [(r.split()[0], int(r.split()[1]), int(r.split()[2])) for r in batch]
        frame = spark.createDataFrame(made, "k string, s int, v int")
        arrive(frame.select("k", F.timestamp_seconds("s").cast("string").alias("at"), "v"), root)
        stream = newest_stream(spark.readStream.schema(schema).json(f"{root}/in"), ["k"], ["at"], keep_ms=None)
        with keyed_state(spark):
            publish_stream(stream, f"{root}/t", f"{root}/c", output_mode="update", available_now=True).awaitTermination()
    found = of_last_epoch(read_published(spark, f"{root}/t", stream.schema), ["k"])
    assert rows(found.select("k", F.unix_seconds("at"), "v")) == [("a", 3, 2), ("b", 5, 1), ("c", 1, 1)]


def test_an_epoch_is_published_once(spark, root):
    batch = spark.range(10)
    assert publish_epoch(batch, 3, root).rows == 10
    assert publish_epoch(batch, 3, root) is None
    assert publish_epoch(spark.range(5), 4, root).bytes_written > 0
    assert rows(epochs(spark, root), "epoch", "rows") == [(3, 10), (4, 5)]
    assert read_published(spark, root, batch.schema).count() == 15


def test_what_was_written_but_not_published_is_not_read_and_written_anew(spark, root):
    spark.range(7).write.parquet(f"{root}/rows/epoch=0")
    assert read_published(spark, root, spark.range(1).schema).count() == 0
    publish_epoch(spark.range(3), 0, root)
    assert rows(read_published(spark, root, spark.range(1).schema)) == [(0, 0), (1, 0), (2, 0)]


def test_a_batch_that_fails_its_gate_stops_the_stream_and_leaves_nothing(spark, root):
    gate = Gate([positive_amount()])
    arrive(raw(spark, {}), root)
    stream = read_stream(spark, "json", RAW, f"{root}/in", per_batch=1)

    def run():
        query = publish_stream(stream, f"{root}/t", f"{root}/c", gate, ["status"], available_now=True, log=f"{root}/log")
        query.awaitTermination()

    run()
    arrive(raw(spark, {"transaction_id": "t2", "amount": -1.0}), root)
    with pytest.raises(StreamingQueryException, match="amount"):
        run()
    assert read_published(spark, f"{root}/t", stream.schema).count() == 1
    assert not fs.exists(spark, f"{root}/t/rows/epoch=1")
    assert rows(read_runs(spark, f"{root}/log"), "success") == [(False,), (True,)]
    with pytest.raises(DataQualityError, match="minimum"):
        publish_epoch(spark.range(0), 9, root, Gate(min_rows=1))


def test_a_replayed_batch_is_published_once(spark, root):
    for name in ("t1", "t2", "t3"):
        arrive(raw(spark, {"transaction_id": name}), root)
    stream = read_stream(spark, "json", RAW, f"{root}/in", per_batch=1)
    run = lambda c: publish_stream(stream, f"{root}/t", f"{root}/{c}", available_now=True).awaitTermination()
    run("c")
    fs.copy(spark, f"{root}/c", f"{root}/copy")
    fs.delete(spark, f"{root}/copy/commits/2")
    run("copy")
    assert rows(read_published(spark, f"{root}/t", stream.schema), "transaction_id") == [("t1",), ("t2",), ("t3",)]


def test_empty_targets(spark, root):
    assert rows(epochs(spark, root)) == []
    assert read_published(spark, root, spark.range(1).schema).columns == ["id", "epoch"]
    assert publish_epoch(spark.range(0), 0, root).rows == 0
    assert read_published(spark, root, spark.range(1).schema).count() == 0


def test_never_forgetting_passes_on_news_only_and_runs_without_python(spark, root):
    versions = [
        raw(spark, {"amount": 5.0}, {"transaction_id": None}, {"transaction_id": "t2", "merchant_name": None}),
        raw(spark, {"amount": 7.0}, {"amount": 6.0}, {"transaction_id": "t2"}),
        raw(spark, {"amount": 6.0}, {"transaction_id": "t2"}, {"transaction_id": None}),
        raw(spark, {"amount": 7.0}, {"transaction_id": "t2", "merchant_name": None}),
    ]
    for part in versions:
        arrive(part, root)
        stream = silver_newest_stream(read_stream(spark, "json", RAW, f"{root}/in"), keep_ms=None)
        with keyed_state(spark):
            publish_stream(stream, f"{root}/t", f"{root}/c", output_mode="update", available_now=True).awaitTermination()
    published = read_published(spark, f"{root}/t", stream.schema)
    everything = versions[0].unionAll(versions[1]).unionAll(versions[2]).unionAll(versions[3])
    assert rows(of_last_epoch(published, ["transaction_id"])) == rows(bronze_to_silver(everything))
    found = published.select("epoch", "transaction_id", F.col("amount").cast("int"), "merchant_name").collect()
    assert sorted(map(tuple, found), key=repr) == [
        (0, "t1", 5, "M"), (0, "t2", 10, None), (0, None, 10, "M"), (1, "t1", 7, "M"), (1, "t2", 10, "M"),
    ]
    assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
