from __future__ import annotations

import uuid
from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeworks.operators import quality as q
from lakeworks.operators.reconcile import reconcile
from lakeworks.operators.zorder import with_zorder
from lakeworks.plans.maintain import analyze, maintain
from lakeworks.schemas import TableStandard
from lakeworks.sources import fs
from lakeworks.sources.audit import Gate
from lakeworks.sources.catalog import CatalogTable, ensure_namespace, is_readable
from lakeworks.sources.files import file_inventory, read_files
from lakeworks.sources.scratch import new_folder, shared_root
from lakeworks.sources.snapshots import SnapshotTable


@pytest.fixture
def root(spark):
    return new_folder(spark, "test")


def numbers(spark, n, start=0):
    return spark.range(start, start + n).select(
        "id", (F.col("id") % 3).cast("string").alias("part"), (F.col("id") * 1.5).alias("v")
    )


# ---- files


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_formats(spark, root, fmt):
    df = numbers(spark, 10)
    df.write.format(fmt).option("header", True).save(f"{root}/{fmt}")
    assert rows(read_files(spark, f"{root}/{fmt}", fmt, df.schema)) == rows(df)


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        read_files(spark, "x", "xml")


def test_inventory(spark, root):
    numbers(spark, 9).write.partitionBy("part").parquet(f"{root}/a")
    numbers(spark, 9).coalesce(1).write.parquet(f"{root}/b")
    got = file_inventory(spark, {"a": f"{root}/a", "b": f"{root}/b"})
    assert {r["partition"] for r in got.where("table = 'a'").collect()} == {"part=0", "part=1", "part=2"}
    assert [r["partition"] for r in got.where("table = 'b'").collect()] == [""]
    assert got.where("length <= 0 OR modificationTime IS NULL OR path LIKE '%_SUCCESS%'").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


class Session:
    """As much of a session as says where it runs."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"applicationId": "app"})


def test_only_a_local_session_gets_a_folder_of_its_own():
    local = Session(spark_master="local[2]")
    assert shared_root(local) == shared_root(local) and Path(shared_root(local)).is_dir()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session(spark_master="spark://host:7077"))


# ---- catalog


def test_catalog_modes(spark, root):
    db = "db_" + uuid.uuid4().hex
    t = CatalogTable(f"{db}.numbers", ("part",), f"{root}/numbers")
    first = t.write(numbers(spark, 6), "create")
    assert (first.rows, first.target_count) == (6, 6)
    size = lambda: sum(r.length for r in file_inventory(spark, {"t": f"{root}/numbers"}).collect())
    assert first.bytes_written == size() > 0
    with pytest.raises(Exception, match="already exists"):
        t.write(numbers(spark, 6), "create")
    more = t.write(numbers(spark, 4, 100), "append")
    assert (more.rows, more.target_count, t.read(spark).count()) == (4, 4, 10)
    assert first.bytes_written + more.bytes_written == size() and more.bytes_written > 0
    again = t.write(numbers(spark, 2), "overwrite")
    assert (again.target_count, t.read(spark).count()) == (2, 2)
    assert fs.exists(spark, f"{root}/numbers/part=0")
    with pytest.raises(q.DataQualityError):
        t.write(numbers(spark, 2), "overwrite", Gate(min_rows=3))
    with pytest.raises(q.DataQualityError):
        t.write(numbers(spark, 2), "overwrite", Gate([q.positive_amount("v")]))
    assert t.read(spark).count() == 2
    # Judged and written are the same rows, though another run would give others.
    chance = numbers(spark, 200).withColumn("v", F.rand() - 0.5)
    passed = t.write(chance.where("v > 0"), "overwrite", Gate([q.positive_amount("v")], min_rows=1))
    assert t.read(spark).where("v <= 0").count() == 0 and t.read(spark).count() == passed.rows
    assert is_readable(spark, t.name) and not is_readable(spark, f"{db}.nope")


def test_namespace(spark):
    name = "ns_" + uuid.uuid4().hex
    ensure_namespace(spark, f"{name}.t")
    ensure_namespace(spark, f"{name}.t")
    ensure_namespace(spark, "plain")
    assert spark.catalog.databaseExists(name)


# ---- snapshots


def test_snapshot_modes(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    first = t.write(numbers(spark, 6), "create")
    assert (first.rows, first.target_count, first.snapshot_id) == (6, 6, 1)
    assert first.bytes_written > 0
    with pytest.raises(FileExistsError):
        t.write(numbers(spark, 6), "create")
    more = t.write(numbers(spark, 4, 100), "append")
    assert (more.rows, more.target_count) == (4, 4)
    assert rows(t.read(spark)) == rows(numbers(spark, 6).unionAll(numbers(spark, 4, 100)))
    t.write(numbers(spark, 2))
    assert rows(t.read(spark)) == rows(numbers(spark, 2))
    assert rows(t.read(spark, 2)) == rows(numbers(spark, 6).unionAll(numbers(spark, 4, 100)))
    with pytest.raises(ValueError, match="another schema"):
        t.write(spark.range(3), "append")
    with pytest.raises(FileNotFoundError):
        t.read(spark, 9)


def test_of_two_writers_of_a_version_one_fails(spark, root):
    t = SnapshotTable(f"{root}/t")
    t.write(numbers(spark, 6))
    schema, directories = t._contents(spark)
    assert t._commit(spark, schema, directories, 1) == 2
    with pytest.raises(Exception, match="(?i)exist"):
        t._commit(spark, schema, {}, 1)
    assert t.read(spark).count() == 6 and t.snapshot_ids(spark) == [1, 2]
    assert not [n for n in fs.child_names(spark, f"{root}/t/manifest") if n.startswith(".") and not n.endswith(".crc")]


def test_a_table_keeps_its_partition_columns(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    t.write(numbers(spark, 6))
    assert SnapshotTable.existing(spark, t.root) == t
    for careless in (lambda o: o.write(numbers(spark, 1), "append"), lambda o: o.compact(spark)):
        with pytest.raises(ValueError, match="partitioned by"):
            careless(SnapshotTable(t.root))
    assert rows(SnapshotTable(t.root).read(spark)) == rows(numbers(spark, 6))
    with pytest.raises(FileNotFoundError):
        SnapshotTable.existing(spark, f"{root}/nothing")


def test_overwriting_what_is_being_read_is_safe(spark, root):
    t = SnapshotTable(f"{root}/t")
    t.write(numbers(spark, 6))
    t.write(t.read(spark).where("id < 3"))
    assert rows(t.read(spark)) == rows(numbers(spark, 3))


def test_empty_and_odd_partitions(spark, root):
    empty = SnapshotTable(f"{root}/empty", ("part",))
    assert empty.write(numbers(spark, 0)).rows == 0
    assert empty.read(spark).schema.fieldNames() == ["id", "part", "v"] and empty.read(spark).count() == 0
    assert SnapshotTable(f"{root}/flat").write(numbers(spark, 0)).target_count == 0
    odd = spark.createDataFrame([(1, "a b+c:d%/é"), (2, None), (3, "x=y")], "id int, part string")
    t = SnapshotTable(f"{root}/odd", ("part",))
    t.write(odd)
    t.write(odd, "append")
    assert rows(t.read(spark)) == rows(odd.unionAll(odd))
    assert t.compact(spark) > 0
    assert rows(t.read(spark)) == rows(odd.unionAll(odd))


def test_failed_audit_leaves_the_table(spark, root):
    t = SnapshotTable(f"{root}/t")
    t.write(numbers(spark, 6))
    doubled = numbers(spark, 6).unionAll(numbers(spark, 6))
    for gate, rows_ in (
        (Gate(min_rows=7), numbers(spark, 6)),
        (Gate([q.positive_amount("v")]), numbers(spark, 6)),
        (Gate([q.unique_id("id")]), doubled),
    ):
        with pytest.raises(q.DataQualityError):
            t.write(rows_, "overwrite", gate)
    assert t.snapshot_ids(spark) == [1] and t.read(spark).count() == 6
    assert len(fs.child_names(spark, f"{root}/t/data")) == 1
    lenient = Gate([q.positive_amount("v"), q.unique_id("id")], min_score=0.5)
    assert t.write(numbers(spark, 6), "overwrite", lenient).quality_score == 0.5


def test_a_table_standard_as_a_gate(spark, root):
    t = SnapshotTable(f"{root}/t")
    standard = TableStandard("numbers", {"id": "bigint", "v": "double"}, {"v": 0.1})
    df = numbers(spark, 20)
    assert t.write(df, gate=Gate(q.standard_rules(df, standard))).quality_score == 1.0
    holes = df.withColumn("v", F.when(F.col("id") > 5, F.col("v")))
    with pytest.raises(q.DataQualityError, match="v null ratio 0.3000"):
        t.write(holes, gate=Gate(q.standard_rules(holes, standard)))
    with pytest.raises(q.DataQualityError, match="v missing"):
        t.write(df.drop("v"), gate=Gate(q.standard_rules(df.drop("v"), standard)))
    # The share that must pass can be lowered, as an operator would to 0.95.
    assert t.write(holes, gate=Gate(q.standard_rules(holes, standard), min_score=0.6)).quality_score == pytest.approx(2 / 3)


def test_compaction_keeps_rows_and_touches_only_small_files(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    for i in range(3):
        t.write(numbers(spark, 30, 30 * i).where("part < 2"), "append")
    t.write(numbers(spark, 30).where("part = 2"), "append")
    before = t.read(spark)
    untouched = {r["path"] for r in t.files(spark).where("partition = 'part=2'").collect()}
    assert t.compact(spark) == 4
    assert reconcile(before, t.read(spark)).first()["passed"]
    files = t.files(spark)
    assert {r["path"] for r in files.where("partition = 'part=2'").collect()} == untouched
    assert files.count() == 3
    assert t.compact(spark) == 0


def test_full_size_files_keep_their_names(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    big = spark.range(20000).select("id", F.lit(0).alias("part"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    t.write(big.coalesce(1))
    t.write(big.where("id < 300").coalesce(1), "append")
    t.write(big.where("id < 200").coalesce(1), "append")
    # One directory that holds a full-size file beside small ones.
    mixed = f"{root}/t/data/load=mixed"
    for rows_ in (big, big.where("id < 10"), big.where("id < 20")):
        rows_.coalesce(1).write.mode("append").partitionBy("part").parquet(mixed)
    schema, known = t._contents(spark)
    t._commit(spark, schema, known | {"load=mixed/part=0": 1}, t.snapshot_ids(spark)[-1])
    sizes = {r["path"]: r["length"] for r in t.files(spark).collect()}
    target = max(sizes.values())
    full = {p for p, n in sizes.items() if n >= 0.75 * target}
    before = rows(t.read(spark))
    assert len(full) == 2 and len(sizes) == 6
    assert t.compact(spark, target) == 3
    left = {r["path"] for r in t.files(spark).collect()}
    assert full < left and len(left) == 3 and rows(t.read(spark)) == before
    assert t.compact(spark, target) == 0
    # The small files of the mixed directory go, its full one stays.
    gone = t.expire_snapshots(spark, retain_last=1)
    assert len(gone) == 4 and rows(t.read(spark)) == before
    soon = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    assert t.remove_orphan_files(spark, soon) == []
    t.write(big.where("id < 5").coalesce(1), "append")
    assert t.compact(spark, target) == 1 and t.read(spark).count() == len(before) + 5


def test_zorder_narrows_files_in_every_column(spark, root):
    df = spark.range(20000).select(
        (F.col("id") * 7919 % 10007).alias("a"), F.date_add(F.lit("2024-01-01"), (F.col("id") * 31 % 997).cast("int")).alias("d"),
        F.when(F.col("id") % 50 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("s"),
    )
    t = SnapshotTable(f"{root}/t")
    t.write(df)
    size = t.files(spark).agg(F.sum("length")).first()[0]
    assert t.rewrite_sorted(spark, ["a", "d"], size // 16, zorder=True) >= 16
    assert reconcile(df, t.read(spark)).first()["passed"]
    spans = t.read(spark).groupBy(F.input_file_name()).agg(
        (F.max("a") - F.min("a")).alias("a"), F.datediff(F.max("d"), F.min("d")).alias("d")
    )
    wide = spans.agg(F.avg("a"), F.avg("d")).first()
    assert wide[0] < 10007 / 2 and wide[1] < 997 / 2
    t.rewrite_sorted(spark, ["s", "a", "d"], size // 4, zorder=True)
    assert reconcile(df, t.read(spark)).first()["passed"]
    with pytest.raises(ValueError, match="columns can be interleaved"):
        with_zorder(df, [])


def test_files_of_a_crash_are_orphans(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    t.write(numbers(spark, 6))
    numbers(spark, 3).write.partitionBy("part").parquet(f"{root}/t/data/load=x/_temporary/0/_temporary/attempt_1")
    numbers(spark, 3).coalesce(1).write.parquet(f"{root}/t/data/load=x/_temporary/0/task_2")
    soon = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    named = t.remove_orphan_files(spark, soon, dry_run=False)
    assert any("attempt_1/part=" in p for p in named) and any("task_2" in p for p in named)
    assert t.remove_orphan_files(spark, soon) == [] and rows(t.read(spark)) == rows(numbers(spark, 6))


def test_sorted_rewrite_splits_a_value_that_holds_most_rows(spark, root):
    hot = F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id"))
    df = spark.range(30000).select("id", hot.alias("k"))
    t = SnapshotTable(f"{root}/t")
    t.write(df)
    size = t.files(spark).agg(F.sum("length")).first()[0]
    assert t.rewrite_sorted(spark, ["k"], size // 6) >= 6
    assert reconcile(df, t.read(spark)).first()["passed"]
    per_file = t.read(spark).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("k"), F.max("k"))
    got = per_file.orderBy("min(k)", "max(k)").collect()
    assert max(r["n"] for r in got) < 30000 / 3
    assert all(a["max(k)"] <= b["min(k)"] for a, b in zip(got, got[1:]))


def test_a_hot_partition_is_written_by_many_tasks(spark, root):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        skewed = spark.range(200000).repartition(8).select(
            F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string").substr(1, 1)).alias("part"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"),
        )
        t = SnapshotTable(f"{root}/t", ("part",))
        t.write(skewed)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert t.files(spark).where("partition = 'part=hot'").count() > 4
    assert t.read(spark).count() == 200000


def test_expiry_and_orphans(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    for i in range(4):
        t.write(numbers(spark, 6, i), "append" if i == 1 else "overwrite")
    kept = rows(t.read(spark, 3))
    doomed = t.expire_snapshots(spark, retain_last=2)
    assert t.snapshot_ids(spark) == [3, 4] and doomed
    assert rows(t.read(spark, 3)) == kept
    assert not any(fs.exists(spark, f"{root}/t/data/{d}") for d in doomed)
    numbers(spark, 3).write.parquet(f"{root}/t/data/load=lost")
    soon, past = F.current_timestamp() + F.expr("INTERVAL 1 HOUR"), F.lit("2020-01-01").cast("timestamp")
    assert t.remove_orphan_files(spark, past) == t.remove_orphan_files(spark) == []
    named = t.remove_orphan_files(spark, soon)
    assert named and all("load=lost" in p for p in named)
    assert t.remove_orphan_files(spark, soon, dry_run=False) == named
    assert t.remove_orphan_files(spark, soon) == []
    assert rows(t.read(spark, 3)) == kept and t.read(spark).count() == 6


def test_expiry_keeps_what_a_compacted_version_carries_over(spark, root):
    t = SnapshotTable(f"{root}/t", ("part",))
    t.write(numbers(spark, 9))
    t.write(numbers(spark, 9, 9).where("part = 1"), "append")
    before = rows(t.read(spark))
    t.compact(spark)
    t.expire_snapshots(spark, retain_last=1)
    assert rows(t.read(spark)) == before


def test_maintenance_sweep(spark, root):
    busy, quiet = SnapshotTable(f"{root}/busy"), SnapshotTable(f"{root}/quiet")
    busy.write(numbers(spark, 5000).repartition(120))
    quiet.write(numbers(spark, 10).coalesce(1))
    tables = {"busy": busy, "quiet": quiet}
    plan = {r["table"]: (r["file_count"], r["priority"]) for r in analyze(spark, tables).collect()}
    assert plan == {"busy": (120, "HIGH"), "quiet": (1, "LOW")}
    done = maintain(spark, tables, retain_last=1)
    assert [(r["table"], r["rewrite"]) for r in done] == [("busy", "compact"), ("quiet", "none")]
    assert busy.files(spark).count() == 1 and rows(busy.read(spark)) == rows(numbers(spark, 5000))
    assert busy.snapshot_ids(spark) == [2] and quiet.snapshot_ids(spark) == [1]


def test_an_append_that_lost_the_race_follows_the_winner(spark, tmp_path, monkeypatch):
    target = SnapshotTable(str(tmp_path / "race"))
    target.write(spark.range(3))
    check, raced = SnapshotTable._check_mode, []

    def with_rival(self, session, df, mode):
        seen = check(self, session, df, mode)
        if not raced:
            raced.append(True)
            target.write(spark.range(10, 12), "append")
        return seen

    monkeypatch.setattr(SnapshotTable, "_check_mode", with_rival)
    target.write(spark.range(20, 21), "append")
    assert sorted(r.id for r in target.read(spark).collect()) == [0, 1, 2, 10, 11, 20]
    assert target.snapshot_ids(spark) == [1, 2, 3]


def test_rows_that_did_not_arrive_are_not_published(spark, tmp_path, monkeypatch):
    target = SnapshotTable(str(tmp_path / "short"))
    target.write(spark.range(3))
    inspect = SnapshotTable._inspect

    def one_short(self, *args):
        directories, rows, size = inspect(self, *args)
        return directories, rows - 1, size

    monkeypatch.setattr(SnapshotTable, "_inspect", one_short)
    with pytest.raises(RuntimeError, match="source=5, target=4"):
        target.write(spark.range(5))
    assert target.snapshot_ids(spark) == [1]
    assert target.read(spark).count() == 3
    assert len(list((tmp_path / "short" / "data").iterdir())) == 1
