from __future__ import annotations

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeworks.operators import synth
from lakeworks.schemas import RAW_COLUMNS


def test_columns_types_and_seed(spark):
    df = synth.synthetic_transactions(spark.range(500), seed=1)
    assert df.columns == RAW_COLUMNS
    assert {t for c, t in df.dtypes if c in ("amount", "balance_after")} == {"double"}
    spread = synth.synthetic_transactions(spark.range(500).repartition(7), seed=1)
    assert rows(df) == rows(spread)
    assert rows(df) != rows(synth.synthetic_transactions(spark.range(500), seed=2))


def test_distribution(spark):
    n = 40000
    df = synth.synthetic_transactions(spark.range(n))
    shares = {r["status"]: r["count"] / n for r in df.groupBy("status").count().collect()}
    assert shares == pytest.approx(synth.STATUS_WEIGHTS, abs=0.01)
    kinds = {r["channel"]: r["count"] / n for r in df.groupBy("channel").count().collect()}
    assert kinds == pytest.approx(dict.fromkeys(synth.CHANNELS, 1 / 6), abs=0.01)
    assert df.agg(F.avg("amount")).first()[0] == pytest.approx(250005, rel=0.02)
    assert abs(df.stat.corr("amount", "balance_after")) < 0.02
    assert df.select("transaction_id").distinct().count() == n


def test_learned_rows_look_like_their_source(spark):
    source = spark.range(20000).select(
        (F.randn(1) * 10 + 100).alias("a"), F.randn(2).alias("noise"), F.rand(3).alias("u")
    )
    source = source.select(
        "a",
        (F.col("a") * 2 + F.col("noise") * 5).alias("b"),
        F.when(F.col("u") < 0.7, "x").when(F.col("u") < 0.95, "y").otherwise("z").alias("c"),
    )
    profile = synth.learn(source, ["a", "b"], ["c"])
    made = synth.sample(spark.range(20000), profile).drop("id")
    assert made.columns == ["a", "b", "c"]
    assert made.stat.corr("a", "b") == pytest.approx(source.stat.corr("a", "b"), abs=0.05)
    for c in ("a", "b"):
        here, there = (df.agg(F.avg(c), F.stddev(c)).first() for df in (source, made))
        assert tuple(there) == pytest.approx(tuple(here), rel=0.1)
    shares = {r["c"]: r["count"] / 20000 for r in made.groupBy("c").count().collect()}
    assert shares == pytest.approx({"x": 0.7, "y": 0.25, "z": 0.05}, abs=0.02)


def test_learning_edge_cases(spark):
    empty = spark.createDataFrame([], "a double, c string")
    made = synth.sample(spark.range(3), synth.learn(empty, ["a"], ["c"]))
    assert rows(made, "a", "c") == [(None, None)] * 3
    constant = spark.range(10).select(F.lit(5.0).alias("a"), F.lit("k").alias("c"))
    assert rows(synth.sample(spark.range(2), synth.learn(constant, ["a"], ["c"])), "a", "c") == [(5.0, "k")] * 2


def test_columns_of_many_values_keep_their_shares(spark):
    n = 20000
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 3001))
    source = spark.range(n).select(hot.alias("c"), F.lit("k").alias("d"))
    profile = synth.learn(source, [], ["c", "d"])
    assert list(profile.tables) == ["c"] and list(profile.shares) == ["d"]
    made = synth.sample(spark.range(n), profile)
    assert made.columns == ["id", "d", "c"] and made.count() == n
    assert made.where("c = 'hot'").count() / n == pytest.approx(1 / 3, abs=0.02)
    assert made.join(source, "c", "left_anti").count() == 0
    assert made.select("c").distinct().count() > 2500
    # The numbers of the values leave no gap and do not overlap.
    spans = sorted({(r["first"], r["end"]) for r in profile.tables["c"].table.collect()})
    assert spans[0][0] == 0 and spans[-1][1] == n
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_nulls_times_and_ids(spark):
    source = spark.range(5000).select(
        F.when(F.col("id") % 4 > 0, F.col("id")).alias("a"),
        F.when(F.col("id") % 2 > 0, F.lit("x")).alias("c"),
        F.when(F.col("id") % 10 > 0, F.expr("string(timestamp_seconds(1700000000 + id))")).alias("t"),
        F.lit(None).cast("string").alias("never"),
    )
    profile = synth.learn(source, ["a"], ["c", "never"], times=["t"], ids=["key"])
    made = synth.sample(spark.range(5000), profile).cache()
    shares = made.select([F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("a", "c", "t", "never", "key")])
    assert tuple(shares.first()) == pytest.approx((0.25, 0.5, 0.1, 1.0, 0.0), abs=0.03)
    assert made.select("key").distinct().count() == 5000
    assert made.where("t NOT RLIKE '^2023-11-1[45]T'").count() == 0
    assert rows(synth.sample(spark.range(5000).repartition(5), profile)) == rows(made)
    made.unpersist()


def test_root_of_a_matrix_that_is_not_positive():
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    root = synth._root(bad)
    assert np.allclose(np.diag(root @ root.T), 1.0)


def test_alias_cells_give_every_value_its_share():
    share = {"a": 0.5, "b": 0.25, "c": 0.15, "d": 0.0999, "e": 0.0001}
    for bins in (1, 3, 64):
        cells = synth.alias_cells(share, bins)
        got = dict.fromkeys(share, 0.0)
        for first, size in zip(cells.first, cells.size):
            assert size <= len(share)
            for i in range(first, first + size):
                got[cells.own[i]] += cells.keep[i] / size / bins
                got[cells.other[i]] += (1 - cells.keep[i]) / size / bins
        assert got == pytest.approx(share)
    # Stretches follow the order of the values: the first ones hold the first value only.
    cells = synth.alias_cells(share, 64)
    assert set(cells.own[: cells.first[30]]) == {"a"} and cells.own[-1] == "e"


def test_many_values_without_correlation_keep_their_shares(spark):
    names = [f"name, \"{i}\" é\u001f" for i in range(800)]
    share = {n: (i + 1) / (800 * 801 / 2) for i, n in enumerate(names)}
    made = synth.sample(spark.range(200000), synth.Profile(shares={"c": share}))
    found = {r["c"]: r["count"] / 200000 for r in made.groupBy("c").count().collect()}
    assert set(found) <= set(share)
    assert sum(abs(found.get(n, 0) - s) for n, s in share.items()) / 2 < np.sqrt(800 / 200000)


def test_correlation_of_categories_and_numbers_is_kept(spark):
    base = spark.range(30000).select(F.randn(1).alias("x"), F.randn(2).alias("e"), F.randn(3).alias("f"))
    group = lambda c, n: F.concat(F.lit("g"), F.least(F.greatest(F.floor(c + n), F.lit(0)), F.lit(2 * n)))
    source = base.select(
        "x",
        group(F.col("x"), 1).alias("few"),
        group(F.col("x") * 0.8 + F.col("e") * 0.6, 2).alias("some"),
        F.concat(F.lit("k"), F.floor(F.rand(9) * 300)).alias("alone"),
        F.col("f").alias("y"),
    )
    source.write.mode("overwrite").parquet(path := synth.new_folder(spark, "source"))
    source = spark.read.parquet(path)
    profile = synth.learn(source, ["x", "y"], ["few", "some", "alone"])
    linked, root = synth._linked(profile)
    assert {"x", "few", "some"} <= set(linked) and "alone" not in linked
    assert np.allclose((root**2).sum(1), 1)
    made = synth.sample(spark.range(30000), profile)
    off = np.abs(synth.score_correlation(made, profile) - profile.correlation)
    assert np.abs(profile.correlation[0, 2:4]).max() > 0.4 and off.max() < 0.08


def test_columns_drawn_alone_follow_their_quantiles(spark):
    profile = synth.Profile(grids={"a": [0.0, 1.0, 10.0]})
    made = synth.sample(spark.range(20000), profile)
    assert made.agg(F.min("a") >= 0, F.max("a") <= 10).first()[:] == (True, True)
    assert made.where("a < 1").count() / 20000 == pytest.approx(0.5, abs=0.02)
    assert made.where("a < 5.5").count() / 20000 == pytest.approx(0.75, abs=0.02)


def test_scores_of_numbers_at_and_between_their_bounds(spark):
    grid, bins = [0.0, 1.0, 1.0, 1.0, 7.5], 4
    leaves = [synth.NORMAL.inv_cdf((i + 0.5) / bins) for i in range(bins)]
    values = [-1.0, 0.0, 0.999, 1.0, 1.001, 7.5, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(synth._number_score(F.col("v"), grid, bins)).collect()]
    assert found == [leaves[0], leaves[0], leaves[0], leaves[3], leaves[3], leaves[3], leaves[3], None]
