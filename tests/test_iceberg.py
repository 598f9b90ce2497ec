"""Only the texts sent to Spark: the Iceberg package is not available here."""

from __future__ import annotations

import pytest

from lakeworks.plans.maintain import maintain
from lakeworks.sources.iceberg import IcebergTable


class Recorder:
    def __init__(self, conf):
        self.conf, self.sent = conf, []

    def sql(self, text):
        self.sent.append(text)


def test_procedures():
    spark = Recorder({"spark.sql.catalog.lake": "org.apache.iceberg.spark.SparkCatalog"})
    t = IcebergTable("lake.db.t")
    t.compact(spark)
    t.compact(spark, 1000)
    t.rewrite_sorted(spark, ["a", "b"])
    t.rewrite_sorted(spark, ["a", "b"], 1000, zorder=True)
    t.expire_snapshots(spark, 7)
    t.remove_orphan_files(spark)
    rewrite, of = "CALL lake.system.rewrite_data_files(table => 'lake.db.t', ", "options => map('target-file-size-bytes', "
    assert spark.sent == [
        f"{rewrite}{of}'268435456'))",
        f"{rewrite}{of}'1000'))",
        f"{rewrite}strategy => 'sort', sort_order => 'a,b', {of}'268435456'))",
        f"{rewrite}strategy => 'sort', sort_order => 'zorder(a,b)', {of}'1000'))",
        "CALL lake.system.expire_snapshots(table => 'lake.db.t', retain_last => 7)",
        "CALL lake.system.remove_orphan_files(table => 'lake.db.t')",
    ]


def test_the_sweep_calls_it_as_it_calls_other_tables(spark, monkeypatch):
    listed = spark.sql("SELECT 'f' || id AS file_path, 10L AS file_size_in_bytes FROM range(120)")
    listed.createOrReplaceTempView("iceberg_files_stub")
    monkeypatch.setattr(IcebergTable, "_require", lambda self, session: None)
    monkeypatch.setattr(IcebergTable, "catalog", "lake")
    sent, files = [], IcebergTable.files
    monkeypatch.setattr(IcebergTable, "_call", lambda self, session, name, rest="": sent.append((name, rest)))
    stub = type("Session", (), {"table": lambda self, name: spark.table("iceberg_files_stub")})()
    monkeypatch.setattr(IcebergTable, "files", lambda self, session, name=None: files(self, stub, name))
    done = maintain(spark, {"t": IcebergTable("lake.db.t")}, "hybrid", sort_columns=["a"], zorder=True)
    assert [(r["table"], r["file_count"], r["rewrite"]) for r in done] == [("t", 120, "sort")]
    assert [name for name, _ in sent] == ["rewrite_data_files", "expire_snapshots"] and "zorder(a)" in sent[0][1]


def test_other_catalogs_are_refused(spark):
    with pytest.raises(RuntimeError, match="no Iceberg catalog"):
        IcebergTable("db.t").write(spark.range(1))
    with pytest.raises(RuntimeError, match="no Iceberg catalog"):
        IcebergTable("db.t").compact(Recorder({}))
