from __future__ import annotations

import pytest

from lakeworks.__main__ import open_table, parser, run
from lakeworks.sources.catalog import CatalogTable
from lakeworks.sources.scratch import new_folder
from lakeworks.sources.snapshots import SnapshotTable


def job(spark, text):
    return run(spark, parser().parse_args(text.split()))


def test_tables_by_name(spark):
    assert open_table(spark, "hdfs://x/y", ["d"]) == SnapshotTable("hdfs://x/y", ("d",))
    assert open_table(spark, "db.t") == CatalogTable("db.t")


def test_all_jobs_in_a_row(spark, capsys):
    r = new_folder(spark, "jobs")
    made = job(spark, f"generate --output-dir {r}/raw --target-gb 0.00002")
    spark.read.json(f"{r}/raw").write.orc(f"{r}/orc")
    moved = job(spark, f"migrate --source-path {r}/orc --target {r}/moved --format orc --partition-cols status, --log {r}/log")
    assert moved.rows == made["total_rows"]
    copied = job(spark, f"copy --source {r}/moved --target {r}/copied --dedup-keys branch_code --log {r}/log")
    assert 0 < copied.rows < moved.rows
    done = job(spark, f"ingest --source-path {r}/raw --target {r}/bronze --mode create --log {r}/log")
    assert (done.bronze.rows, done.quarantined) == (made["total_rows"], False)
    layers = job(spark, f"report --bronze {r}/bronze --silver {r}/silver --gold {r}/gold --log {r}/log")
    assert layers["silver"].rows >= layers["gold"].rows > 0
    kept = job(spark, f"maintain --table {r}/moved --table {r}/copied --force --sort amount --retain-last 1")
    assert [k["rewrite"] for k in kept] == ["sort", "sort"]
    assert SnapshotTable.existing(spark, f"{r}/moved") == SnapshotTable(f"{r}/moved", ("status",))
    assert SnapshotTable(f"{r}/moved").read(spark).count() == moved.rows
    job(spark, f"metrics --log {r}/log --lines 2")
    shown = capsys.readouterr().out
    assert "critical_etl" in shown and "batch_migration" in shown and "json_to_bronze" in shown


def test_unknown_mode_is_refused():
    with pytest.raises(SystemExit):
        parser().parse_args(["ingest", "--source-path", "a", "--target", "b", "--mode", "merge"])
