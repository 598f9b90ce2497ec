from __future__ import annotations

import random

import pytest
from frames import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeworks.operators import batches as b
from lakeworks.operators.reconcile import locate_differences, reconcile, reconcile_counts
from lakeworks.plans import migrate
from lakeworks.schemas import BATCH_LOG
from lakeworks.sources.scratch import new_folder

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PAIR = "a string, b string"


def verdict(spark, x, y):
    r = reconcile(spark.createDataFrame(x, PAIR), spark.createDataFrame(y, PAIR)).first()
    return r["counts_match"], r["checksum_match"], r["passed"]


def test_reconcile_cases(spark):
    x = [("1", "a"), ("2", "b"), ("3", None)]
    assert verdict(spark, x, x[::-1]) == (True, True, True)
    assert verdict(spark, x, [("1", "a"), ("2", "B"), ("3", None)]) == (True, False, False)
    assert verdict(spark, x, [*x, ("4", "d"), ("4", "d")]) == (False, False, False)
    # A null that moved to the other column, and two pairs traded for each other.
    assert verdict(spark, [(None, "a")], [("a", None)]) == (True, False, False)
    assert verdict(spark, [("p", "p")] * 2, [("q", "q")] * 2) == (True, False, False)
    assert verdict(spark, [], []) == (True, True, True)


pair = st.tuples(st.one_of(st.none(), st.sampled_from("ab")), st.one_of(st.none(), st.sampled_from("ab")))


@few
@given(st.lists(pair, max_size=8), st.lists(pair, max_size=8))
def test_reconcile_agrees_with_multisets(spark, x, y):
    assert verdict(spark, x, y)[2] == (sorted(x, key=repr) == sorted(y, key=repr))


def test_reconcile_counts(spark):
    x = spark.range(100)
    assert reconcile_counts(x, x).first()["message"] == "row counts match"
    bad = reconcile_counts(x, spark.range(99)).first()
    assert (bad["passed"], bad["message"]) == (False, "mismatch source=100 target=99")


def files(spark, lengths):
    return spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(lengths)], "path string, length long")


@few
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 40))
def test_batch_plan_is_whole_and_balanced(spark, lengths, size):
    got = b.batch_plan(files(spark, lengths), size, digits=1).collect()
    assert sorted(r["path"] for r in got) == sorted(f"f{i}" for i in range(len(lengths)))
    per_batch = {}
    for r in got:
        per_batch.setdefault(r["batch_id"], []).append(r["length"])
    for batch_id, inside in per_batch.items():
        assert 0 <= batch_id <= sum(lengths) // size
        assert sum(inside) - max(inside) <= size


def test_batch_summary(spark):
    gb = b.GB
    whole = b.batch_summary(files(spark, [gb] * 4)).first()
    assert (whole["batch_count"], whole["recommended_parallelism"]) == (2, 2)
    assert b.batch_summary(files(spark, [])).first()["batch_count"] == 1
    assert b.batch_summary(files(spark, [gb] * 40)).first()["recommended_parallelism"] == 4


def log(spark, *attempts):
    full = [(i, a, n if ok else 0, n * 10, 1.0, ok, None if ok else "e") for i, a, n, ok in attempts]
    return spark.createDataFrame(full, BATCH_LOG)


def test_batches_to_retry(spark):
    plan = spark.createDataFrame([(i,) for i in range(5)], "batch_id long")
    attempts = log(
        spark,
        (0, 1, 5, True),
        (1, 1, 5, False),
        (2, 1, 5, False),
        (2, 2, 5, True),
        (3, 1, 5, False),
        (3, 2, 5, False),
    )
    got = rows(b.batches_to_retry(plan, attempts, max_attempts=2), "batch_id", "attempts", "action", "error")
    assert got == [(1, 1, "retry", None), (3, 2, "dead", "max retries exceeded"), (4, 0, "run", None)]


def test_progress_counts_retried_batches_as_done(spark):
    attempts = log(spark, (0, 1, 5, True), (1, 1, 5, False), (1, 2, 7, True), (2, 1, 1, False))
    p = b.migration_progress(attempts, 4, 1000, 10.0, 12).first()
    assert (p["completed_batches"], p["failed_batches"], p["total_rows"], p["processed_bytes"]) == (2, 1, 12, 120)
    assert p["bytes_per_second"] == 12 and p["seconds_left"] == pytest.approx(880 / 12)
    assert p["sla_at_risk"] is True
    quick = b.migration_progress(attempts, 4, 0, 0.1, 1).first()
    assert (quick["bytes_per_second"], quick["seconds_left"], quick["sla_at_risk"]) == (120, None, False)
    # At risk only past 80 % of the limit, not at it.
    assert b.migration_progress(attempts, 4, 0, 8.0, 10).first()["sla_at_risk"] is False
    assert b.migration_progress(log(spark), 4, 100, 1.0).first()["seconds_left"] is None


def test_batch_plan_does_not_depend_on_order(spark):
    lengths = [random.Random(3).randint(1, 99) for _ in range(200)]
    one = rows(b.batch_plan(files(spark, lengths), 500))
    assert rows(b.batch_plan(files(spark, lengths).repartition(7, "length"), 500)) == one


def located(x, y):
    """What a comparison of the multisets of each key says."""
    status = {}
    for key in {r[0] for r in [*x, *y]}:
        here, there = (sorted((r for r in side if r[0] == key), key=repr) for side in (x, y))
        if here != there:
            status[key] = "missing" if not there else "extra" if not here else "changed"
    return sorted(((k, s) for k, s in status.items()), key=repr)


@few
@given(st.lists(pair, max_size=8), st.lists(pair, max_size=8), st.sampled_from([(1, 1), (3, 2)]))
def test_located_differences_agree_with_multisets(spark, x, y, shape):
    frames = [spark.createDataFrame(side, PAIR) for side in (x, y)]
    found = locate_differences(*frames, ["a"], bits=shape[0], levels=shape[1])
    assert rows(found, "a", "status") == located(x, y)


def test_locating_differences_of_large_tables(spark):
    x = spark.range(20000).select((F.col("id") % 7000).alias("k"), (F.col("id") / 3).alias("v"), F.lit("x").alias("t"))
    y = x.where("k <> 17").withColumn("v", F.when(F.col("k") == 4711, F.lit(0.5)).otherwise(F.col("v")))
    y = y.unionAll(spark.createDataFrame([(7001, 1.0, "x")], x.schema))
    found = locate_differences(x, y.repartition(5).select("t", "v", "k"), ["k"])
    assert rows(found) == [(17, "missing", 3, 0), (4711, "changed", 3, 3), (7001, "extra", 0, 1)]
    assert rows(locate_differences(x, x.repartition(3), ["k"])) == []
    # Two columns as the key, an int against the same long, only some columns compared.
    as_int = x.withColumn("k", F.col("k").cast("int")).withColumn("t", F.lit("other"))
    assert rows(locate_differences(x, as_int, ["k", "v"], ["k", "v"])) == []


def test_many_batches_take_few_jobs(spark):
    root = new_folder(spark, "many")
    spark.range(4000).repartition(100).write.parquet(f"{root}/in")
    size = spark.read.format("binaryFile").load(f"{root}/in").agg(F.sum("length")).first()[0]
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    progress = migrate.migrate_in_batches(spark, f"{root}/in", f"{root}/out", batch_bytes=size // 100).first()
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before
    assert progress["completed_batches"] > 60 and progress["failed_batches"] == 0
    assert (progress["total_rows"], progress["processed_bytes"]) == (4000, size)
    assert len(jobs) <= 30  # however many batches there are; Spark runs several jobs for one shuffled query
    assert sorted(r["id"] for r in migrate.read_batches(spark, f"{root}/out").collect()) == list(range(4000))


def test_only_the_batch_with_the_bad_file_fails(spark):
    root = new_folder(spark, "bad")
    spark.range(800).repartition(8).write.parquet(f"{root}/in")
    spark.createDataFrame([("no parquet at all",)], "value string").coalesce(1).write.text(f"{root}/text")
    bad = spark.read.format("binaryFile").load(f"{root}/text").first()["path"]
    with open(bad.removeprefix("file:"), "rb") as source, open(f"{root}/in/part-bad+1 %20.parquet", "wb") as target:
        target.write(source.read())
    progress = migrate.migrate_in_batches(
        spark, f"{root}/in", f"{root}/out", schema="id long", batch_bytes=1, max_retries=1, backoff_seconds=0.0
    ).first()
    assert (progress["completed_batches"], progress["failed_batches"], progress["total_rows"]) == (8, 1, 800)
    assert migrate.read_batches(spark, f"{root}/out").distinct().count() == 800


def test_a_transform_sees_batches_and_keeps_them(spark):
    root = new_folder(spark, "transform")
    spark.range(60).repartition(3).write.parquet(f"{root}/in")
    some = lambda df: df.where("id >= 30").withColumn("of", F.col("batch_id"))
    migrate.migrate_in_batches(spark, f"{root}/in", f"{root}/out", batch_bytes=1, transform=some)
    found = migrate.read_batches(spark, f"{root}/out")
    assert found.columns == ["id", "of"] and found.count() == 30 and found.select("of").distinct().count() == 3
    progress = migrate.migrate_in_batches(
        spark, f"{root}/in", f"{root}/none", transform=lambda df: df.select("id"), max_retries=0
    )
    assert progress.first()["completed_batches"] == 0
