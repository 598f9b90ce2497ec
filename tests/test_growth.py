"""What must not grow faster than the input: stored text, files of a stream, memory of a task, shuffled columns."""

from __future__ import annotations

import re

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeworks.operators import synth
from lakeworks.plans import catalogue, loads
from lakeworks.plans.star import transactions
from lakeworks.sources import fs, snapshots
from lakeworks.sources.files import file_inventory
from lakeworks.sources.scratch import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folders(spark, monkeypatch):
    """The folders a query makes."""
    made = []

    def new(session, purpose):
        made.append(new_folder(session, purpose))
        return made[-1]

    monkeypatch.setattr(catalogue, "new_folder", new)
    return made


def files(spark, path):
    listing = file_inventory(spark, {"t": path}).select("path").collect()
    return [r["path"].rpartition("/")[2] for r in listing]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quarantine_stores_the_lines_once_and_compressed(spark, folders):
    placed = rows(catalogue.ingest_quarantine(spark, SF))
    assert "raw" not in fs.child_names(spark, folders[0])
    assert all(f.endswith(".txt.gz") for f in files(spark, f"{folders[0]}/cut"))
    ids = transactions(spark, SF, ["transaction_id"])
    assert placed == [("bad", ids.where("transaction_id LIKE '%-7'").count()), ("bronze", ids.where("transaction_id NOT LIKE '%-7'").count())]


def test_raw_json_is_compressed_in_files_of_few_rows(spark, folders, monkeypatch):
    monkeypatch.setattr(catalogue, "FILE_ROWS", 1000)
    found = files(spark, catalogue._raw_json(spark, SF, new_folder(spark, "raw")))
    assert len(found) >= 6 and all(f.endswith(".json.gz") for f in found)


@pytest.mark.parametrize("name", ["stream_silver", "stream_silver_damaged"])
def test_files_of_a_stream_grow_with_the_input(spark, folders, monkeypatch, name):
    least = rows(getattr(catalogue, name)(spark, SF))
    assert len(files(spark, f"{folders[0]}/raw")) == 6
    monkeypatch.setattr(catalogue, "STREAM_FILE_BYTES", 10_000)
    assert rows(getattr(catalogue, name)(spark, SF)) == least
    assert len(files(spark, f"{folders[1]}/raw")) > 9
    assert len(fs.child_names(spark, f"{folders[1]}/checkpoint/commits")) <= 5  # three batches and the metadata


def test_learning_shuffles_no_whole_rows_to_a_fixed_number_of_tasks(spark, folders, monkeypatch):
    monkeypatch.setattr(catalogue, "FILE_ROWS", 250)
    stored = catalogue._learnable(spark, SF)
    assert len(stored.inputFiles()) >= 20
    assert stored.count() == transactions(spark, SF, ["transaction_id"]).count()


def test_line_items_meet_the_orders_last(spark):
    text = plan(transactions(spark, SF))
    # In the tree the line items lie above the customers, which are joined to the orders alone.
    joins = [len(m.group(0)) for m in re.finditer(r"(?m)^.*(?=Join Inner)", text)]
    assert len(joins) == 5
    above_all = next(line for line in text.splitlines() if "Join Inner" in line)
    assert "l_orderkey" in above_all and "o_orderkey" in above_all


def test_drawing_from_tables_shuffles_keys_and_values_only(spark):
    source = spark.range(3000).select(
        F.concat(F.lit("v"), "id").alias("a"), F.concat(F.lit("w"), "id").alias("b"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0).alias("y")
    )
    learned = synth.learn(source, ["x", "y"], ["a", "b"], max_categories=100)
    made = synth.sample(spark.range(500), learned)
    assert made.count() == 500
    joined = plan(made).partition("Join Inner")[2]
    assert "noise:" not in joined and "_z_" not in joined


def largest_method(spark, df):
    """Bytes of the longest method that whole-stage code of a plan has; beyond 8,000 the JVM interprets it."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        parts = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set(name, before)
    return max([parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())], default=0)


@pytest.mark.parametrize("linked", [False, True])
def test_drawing_many_columns_stays_compiled(spark, linked):
    grids = {f"n{i}": [0.0, 1.0, 10.0] for i in range(8)}
    shares = {f"c{i}": {"a": 0.5, "b": 0.3, "c": 0.2} for i in range(8)}
    off = np.full((16, 16), 0.3) + 0.7 * np.eye(16) if linked else None
    nulls = {c: 0.1 for c in [*grids, *shares]}
    made = synth.sample(spark.range(2000), synth.Profile(grids, shares, off, nulls=nulls, ids=["key"]))
    assert largest_method(spark, made) < 8000
    found = made.agg(F.count("*"), F.count("n0"), F.count("c7"), F.count("key")).first()
    assert found[0] == found[3] == 2000 and all(1700 < n < 1900 for n in found[1:3])


def test_scores_of_many_numbers_stay_compiled(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(synth, "_compiled", lambda columns, by, own=synth._compiled: (asked.append(list(columns)), own(columns, by))[1])
    source = spark.range(200).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"n{i}") for i in range(12)])
    learned = synth.learn(source, source.columns)
    assert asked == [["z"]] and learned.correlation.shape == (12, 12)
    scores = F.array(*[synth._number_score(F.col(c), learned.grids[c], 32) for c in source.columns])
    assert largest_method(spark, source.select(scores.alias("z"))) > 8000
    assert largest_method(spark, source.select(synth._compiled({"z": scores}, F.col("n0"))["z"].alias("z"))) < 8000


def test_a_drawn_place_is_hashed_once(spark):
    source = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("a"))
    text = plan(synth.sample(spark.range(500), synth.learn(source, [], ["a"], max_categories=100)))
    met = next(line for line in text.splitlines() if "Join Inner" in line)
    assert "xxhash64" not in met and "_at" in met


def test_values_are_counted_by_the_place_of_their_column(spark):
    source = spark.createDataFrame([("x", None, "1"), ("x", "x", None), (None, "y", None)], "a string, b string, c string")
    pairs = synth.by_column(source, {c: F.col(c) for c in source.columns})
    assert pairs.dtypes == [("place", "int"), ("value", "string")] and pairs.count() == 9
    learned = synth.learn(source, [], source.columns)
    assert learned.shares == {"a": {"x": 1.0}, "b": {"x": 0.5, "y": 0.5}, "c": {"1": 1.0}}
    assert learned.nulls == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 2 / 3})


def test_a_compaction_sorts_no_rows_by_partition(spark, monkeypatch):
    target = snapshots.SnapshotTable(new_folder(spark, "compact"), ("p",))
    for _ in range(3):
        target.write(spark.range(100).withColumn("p", F.col("id") % 3), "append")
    seen, write = [], snapshots.SnapshotTable._write_load
    name = "spark.sql.maxConcurrentOutputFileWriters"
    monkeypatch.setattr(snapshots.SnapshotTable, "_write_load", lambda self, *a: (seen.append(spark.conf.get(name)), write(self, *a)))
    before, content = spark.conf.get(name), rows(target.read(spark))
    assert target.compact(spark) > 0
    assert int(seen[0]) > 0 and spark.conf.get(name) == before
    assert rows(target.read(spark)) == content


@pytest.mark.parametrize("zorder", [False, True])
def test_a_sorted_rewrite_bounds_the_values_a_task_sorts(spark, monkeypatch, zorder):
    target = snapshots.SnapshotTable(new_folder(spark, "sorted"))
    target.write(spark.range(1000).select("id", (F.col("id") % 7).alias("v")))
    monkeypatch.setattr(snapshots, "SORT_VALUES", 200)
    assert target.rewrite_sorted(spark, ["v", "id"], zorder=zorder) >= 8
    assert target.read(spark).count() == 1000


def test_what_is_stored_already_is_not_deduplicated_whole(spark, monkeypatch, tmp_path):
    target = loads.UniqueLoads(str(tmp_path), ["id"])
    load = spark.range(100).withColumn("v", F.col("id") * 2).unionAll(spark.createDataFrame([(None, 1)], "id long, v long"))
    assert target.add(load, "one") == 101
    taken, dedup = [], loads.dedup
    monkeypatch.setattr(loads, "dedup", lambda df, *a: (taken.append(df.count()), dedup(df, *a))[1])
    again = load.unionAll(load).unionAll(spark.range(100, 103).withColumn("v", F.lit(0).cast("long")))
    assert target.add(again, "two") == 3
    assert taken == [3]
    assert target.read(spark).count() == 104
