from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from frames import BASE, raw, rows
from pyspark.sql import functions as F

from lakeworks.operators import quality as q
from lakeworks.operators.metrics import latest_throughput, quality_summary, sla_compliance
from lakeworks.plans import migrate
from lakeworks.plans.generate import generate_json_lines
from lakeworks.plans.medallion import bronze_to_gold, generate_to_gold, ingest_json, layer_tables
from lakeworks.plans.runlog import latest_lines, read_quality, read_runs
from lakeworks.schemas import RAW
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate
from lakeworks.sources.files import bad_records, good_records, read_json_lines
from lakeworks.sources.scratch import new_folder
from lakeworks.sources.snapshots import SnapshotTable


@pytest.fixture
def root(spark):
    return new_folder(spark, "flow")


def lines(spark, root, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.text(f"{root}/lines")
    return f"{root}/lines"


GOOD = json.dumps(BASE)
WRONG_TYPE = json.dumps(BASE | {"amount": "much"})


def test_bad_lines_are_set_apart(spark, root):
    df = read_json_lines(spark, lines(spark, root, GOOD, "{bad", WRONG_TYPE, ""))
    assert good_records(df).count() == 1 and good_records(df).columns == RAW.fieldNames()
    assert bad_records(df).count() == 2
    assert rows(bad_records(df), "_corrupt_record") == rows(
        spark.createDataFrame([("{bad",), (WRONG_TYPE,)], "x string")
    )


def test_json_to_gold(spark, root):
    later = json.dumps(BASE | {"transaction_ts": "2024-01-02T10:00:00", "amount": 20.0})
    other = json.dumps(BASE | {"transaction_id": "t2", "customer_id": "CUST2", "amount": 5.5})
    failed = json.dumps(BASE | {"transaction_id": "t3", "status": "FAILED"})
    path = lines(spark, root, GOOD, later, other, failed, "{bad")
    bronze, silver, gold = layer_tables(root)
    at = datetime(2024, 2, 1)
    ingested = ingest_json(spark, path, bronze, "create", f"{root}/bad", at, f"{root}/log")
    assert (ingested.bronze.rows, ingested.quarantined) == (4, True)
    assert spark.read.json(f"{root}/bad").count() == 1
    assert rows(bronze.read(spark).select("ingest_ts", "source_path").distinct()) == [(at, path)]

    done = bronze_to_gold(spark, bronze, silver, gold, Gate([q.unique_id()], min_rows=2), f"{root}/log")
    assert (done["silver"].rows, done["gold"].rows) == (2, 2)
    assert rows(gold.read(spark), "report_date", "total_amount", "unique_customers") == [
        (date(2024, 1, 1), Decimal("5.50"), 1),
        (date(2024, 1, 2), Decimal("20.00"), 1),
    ]
    assert fs.exists(spark, f"{root}/gold/daily_report/data")
    runs = read_runs(spark, f"{root}/log")
    assert runs.where("success").count() == 3
    assert {r["sla_name"]: r["sla_met"] for r in sla_compliance(runs).collect()} == {
        "critical_etl": True,
        "batch_migration": True,
    }
    assert latest_throughput(runs).where("rows_per_second > 0").count() == 2
    assert quality_summary(read_quality(spark, f"{root}/log")).first()["checks"] == 3


def test_generated_rows_to_gold(spark, root):
    done = generate_to_gold(spark, root, 60_000, f"{root}/log")
    assert done["bronze"].rows > done["silver"].rows >= done["gold"].rows > 0
    assert not fs.exists(spark, f"{root}/bad")
    lines = latest_lines(spark, f"{root}/log", 2).collect()
    assert [(r["log"], r["rn"]) for r in lines] == [("quality", 1), ("quality", 2), ("runs", 1), ("runs", 2)]
    assert '"layer":"gold"' in lines[2]["line"] and '"layer":"silver"' in lines[3]["line"]


def test_ingest_replay_gives_the_same_rows(spark, root):
    path = lines(spark, root, GOOD)
    bronze, _, _ = layer_tables(root)
    at = datetime(2024, 2, 1)
    ingest_json(spark, path, bronze, ingest_ts=at)
    first = rows(bronze.read(spark))
    assert ingest_json(spark, path, bronze, ingest_ts=at).quarantined is False
    assert rows(bronze.read(spark)) == first


def test_failed_gate_is_logged_and_keeps_the_old_silver(spark, root):
    bronze, silver, gold = layer_tables(root)
    bronze.write(raw(spark, {}).withColumn("transaction_date", F.to_date("transaction_ts")))
    bronze_to_gold(spark, bronze, silver, gold)
    with pytest.raises(q.DataQualityError):
        bronze_to_gold(spark, bronze, silver, gold, Gate(min_rows=5), f"{root}/log")
    assert silver.read(spark).count() == 1
    failed = read_runs(spark, f"{root}/log").first()
    assert (failed["success"], failed["layer"]) == (False, "silver") and "below minimum" in failed["error"]


def test_missing_columns_stop_the_run(spark, root):
    bronze, silver, gold = layer_tables(root)
    bronze.write(raw(spark, {}).drop("amount").withColumn("transaction_date", F.to_date("transaction_ts")))
    with pytest.raises(q.DataQualityError, match="amount"):
        bronze_to_gold(spark, bronze, silver, gold)


def test_migrate_counts_only_what_an_append_added(spark, root):
    spark.range(10).write.parquet(f"{root}/in")
    target = SnapshotTable(f"{root}/out")
    for mode in ("create", "append"):
        result = migrate.migrate_files(spark, f"{root}/in", target, mode=mode)
        assert (result.rows, result.target_count) == (10, 10)
    assert target.read(spark).count() == 20


def test_migrate_raises_on_mismatch(spark):
    class Lossy:
        def write(self, df, mode, gate):
            from lakeworks.sources.audit import WriteResult

            return WriteResult("t", 10, 9, 0, 1.0)

    with pytest.raises(RuntimeError, match="source=10, target=9"):
        migrate.migrate_dataframe(spark.range(10), Lossy())
    assert migrate.migrate_dataframe(spark.range(10), Lossy(), validate=False).rows == 10


def test_copy_table(spark, root):
    source, target = SnapshotTable(f"{root}/a"), SnapshotTable(f"{root}/b")
    source.write(spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string"))
    migrate.copy_table(spark, source, target)
    assert target.read(spark).count() == 3
    migrate.copy_table(spark, source, target, ["k"])
    assert rows(target.read(spark)) == [(1, "y"), (2, "z")]
    with pytest.raises(q.DataQualityError):
        migrate.copy_table(spark, source, target, ["k"], min_rows=3)
    assert target.read(spark).count() == 2


def test_governed_run_checks_its_input(spark, root):
    source, target = SnapshotTable(f"{root}/a"), SnapshotTable(f"{root}/b")
    source.write(spark.range(5))
    with pytest.raises(q.DataQualityError, match="Missing"):
        migrate.run_governed(spark, source, target, lambda df: df, ["nope"], log=f"{root}/log")
    assert read_runs(spark, f"{root}/log").where("NOT success").count() == 1
    gate = Gate([q.not_null("id")], min_rows=1)
    done = migrate.run_governed(spark, source, target, lambda df: df.where("id > 1"), ["id"], gate)
    assert (done.rows, done.quality_score) == (3, 1.0)


def test_batches_resume_after_failures(spark, root):
    spark.range(1000).repartition(6).write.parquet(f"{root}/in")
    size = spark.read.format("binaryFile").load(f"{root}/in").agg(F.sum("length")).first()[0]
    arguments = {"batch_bytes": size // 3, "backoff_seconds": 0.0, "parallelism": 2}

    def fail(df):
        raise RuntimeError("no luck")

    progress = migrate.migrate_in_batches(
        spark, f"{root}/in", f"{root}/out", transform=fail, max_retries=0, **arguments
    ).first()
    assert progress["completed_batches"] == 0 and progress["failed_batches"] == progress["total_batches"] >= 2
    calls = []

    def flaky(df):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("once")
        return df

    progress = migrate.migrate_in_batches(
        spark, f"{root}/in", f"{root}/out", transform=flaky, max_retries=3, **arguments
    ).first()
    assert (progress["failed_batches"], progress["total_rows"], progress["processed_bytes"]) == (0, 1000, size)
    assert migrate.read_batches(spark, f"{root}/out").distinct().count() == 1000
    spark.range(5).write.parquet(f"{root}/out/rows/batch_id=999")
    assert migrate.read_batches(spark, f"{root}/out").count() == 1000
    done = len(calls)
    migrate.migrate_in_batches(spark, f"{root}/in", f"{root}/out", transform=flaky, **arguments)
    assert len(calls) == done


def test_generated_json_reaches_its_size(spark, root):
    made = generate_json_lines(spark, f"{root}/out", 300_000, file_bytes=100_000)
    got = spark.read.schema(RAW).json(f"{root}/out")
    assert got.count() == made["total_rows"] and got.where("transaction_id IS NULL").count() == 0
    assert got.select("transaction_id").distinct().count() == made["total_rows"]
    size = spark.read.text(f"{root}/out").agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert 300_000 <= size <= 330_000 and made["files"] >= 3
    assert json.loads(spark.read.text(f"{root}/out/_manifest").first()[0])["total_rows"] == made["total_rows"]
