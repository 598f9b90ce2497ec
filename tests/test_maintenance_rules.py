from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeworks.operators import files as f
from lakeworks.operators import metrics as m
from lakeworks.schemas import QUALITY_LOG, RUNS


def stats(spark, *counts):
    return spark.createDataFrame([(f"t{n:03d}", n) for n in counts], "table string, file_count long")


def test_priorities(spark):
    got = rows(f.predict_maintenance(stats(spark, 0, 49, 50, 99, 100)))
    assert [r[2] for r in got] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert [r[3] for r in got] == [0.2, 0.2, 0.6, 0.6, 0.9]
    assert [r[4] for r in got] == [False, False, True, True, True]


def plan(spark, policy, force, *, sort=()):
    out = f.maintenance_plan(stats(spark, 10, 60, 100), policy, force, sort).orderBy("table")
    return [(r["rewrite"], r["expire_snapshots"], r["scheduled_later"]) for r in out.collect()]


def test_policies(spark):
    none, compact = "none", "compact"
    assert plan(spark, "intelligent", False) == [(none, False, False), (none, False, True), (compact, True, False)]
    assert plan(spark, "intelligent", True) == [(none, True, False), (compact, True, False), (compact, True, False)]
    assert plan(spark, "hybrid", False) == [(none, True, False), (none, True, False), (compact, True, False)]
    assert plan(spark, "hybrid", True, sort=["a"]) == [("sort", True, False)] * 3
    with pytest.raises(ValueError, match="unknown policy"):
        f.maintenance_plan(stats(spark, 1), "other")


def test_file_stats(spark):
    listing = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 4)], "table string, length long")
    assert rows(f.file_stats(listing)) == [("a", 3, 15, 1, 9, 5), ("b", 1, 4, 4, 4, 4)]


def manifest(spark):
    at = datetime(2024, 1, 1)
    data = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (3, "d")]
    return spark.createDataFrame(
        [("t", i, at + timedelta(days=i), p) for i, p in data],
        "table string, snapshot_id long, committed_at timestamp, path string",
    )


def test_expiry(spark):
    assert rows(f.expired_snapshots(manifest(spark), 2), "snapshot_id") == [(1,)]
    assert rows(f.expired_files(manifest(spark), 2)) == [("a",)]
    assert rows(f.expired_files(manifest(spark), 1)) == [("a",), ("b",)]
    assert rows(f.expired_files(manifest(spark), 3)) == []
    with pytest.raises(ValueError, match="newest"):
        f.expired_files(manifest(spark), 0)
    two = manifest(spark).unionAll(manifest(spark).withColumn("table", F.lit("u")).where("snapshot_id < 3"))
    assert rows(f.expired_files(two, 1, by=["table"])) == [("t", "a"), ("t", "b"), ("u", "a")]


def test_orphans(spark):
    listing = spark.createDataFrame(
        [("a", datetime(2024, 1, 1)), ("x", datetime(2024, 1, 1)), ("y", datetime(2024, 3, 1))],
        "path string, modificationTime timestamp",
    )
    assert rows(f.orphan_files(listing, manifest(spark)), "path") == [("x",), ("y",)]
    assert rows(f.orphan_files(listing, manifest(spark), F.lit(datetime(2024, 2, 1))), "path") == [("x",)]


def runs(spark, *rows_):
    fields = RUNS.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows_], RUNS)


def test_throughput(spark):
    got = m.throughput(
        runs(
            spark,
            {"job": "test", "duration_seconds": 10.0, "output_count": 1000},
            {"job": "u", "duration_seconds": 0.0, "target_count": 3, "bytes_processed": 2},
            {"duration_seconds": 2.0},
        )
    )
    assert rows(got, "job", "rows_per_second", "bytes_per_second") == [
        ("test", 100.0, 0.0),
        ("u", 3000.0, 2000.0),
        ("unknown", 0.0, 0.0),
    ]


def test_latest_throughput(spark):
    at = datetime(2024, 1, 1)
    got = m.latest_throughput(
        runs(
            spark,
            {"job": "a", "duration_seconds": 1.0, "output_count": 1, "ts": at},
            {"job": "a", "duration_seconds": 1.0, "output_count": 2, "ts": at + timedelta(days=1)},
        )
    )
    assert rows(got, "job", "rows_per_second") == [("a", 2.0)]


def test_sla(spark):
    def run(seconds, ok=True, sla="critical_etl"):
        return {"sla_name": sla, "duration_seconds": seconds, "success": ok}

    got = m.sla_compliance(
        runs(
            spark, run(1800.0), run(1440.0), run(1441.0), run(1801.0), run(5.0, ok=False), run(1.0, sla="batch_migration")
        )
    )
    assert rows(got, "sla_name", "runs", "failed", "breaches", "at_risk", "compliant", "sla_met") == [
        ("batch_migration", 1, 0, 0, 0, 1, True),
        ("critical_etl", 5, 1, 1, 3, 3, False),
    ]


def test_quality_summary(spark):
    log = spark.createDataFrame(
        [("s", 0.5, i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(12)], QUALITY_LOG
    )
    assert rows(m.quality_summary(log)) == [(12, 0.5)]
    assert rows(m.quality_summary(log.limit(0))) == [(0, 1.0)]
    assert [r["row_count"] for r in m.latest_checks(log).collect()] == list(range(11, 1, -1))
