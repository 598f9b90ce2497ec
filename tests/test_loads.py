"""Loads without repeats, drifting JSON and size sketches, on small literal rows."""

from __future__ import annotations

import random

import pytest
from frames import rows
from pyspark.sql import functions as F

from lakeworks.operators.sketch import ERROR, merge_sketches, size_quantiles, size_sketch
from lakeworks.plans.loads import UniqueLoads, bloom_filter, flagged
from lakeworks.sources.variant import read_variant_lines, typed

SCHEMA = "id string, day int, own string, possible int"


def load(spark, *values):
    return spark.createDataFrame([(i, d, o, 0) for i, d, o in values], SCHEMA)


def stored(target, spark):
    return [tuple(r) for r in rows(target.read(spark), "id", "day", "own", "load")]


def test_first_load_keeps_its_row(spark, tmp_path):
    target = UniqueLoads(str(tmp_path), ["id"], ["day"], blocks=64)
    assert target.add(load(spark, ("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")), "1") == 2
    assert target.add(load(spark, ("a", 9, "z"), ("b", 1, "z"), (None, 5, "m"), ("b", 0, "z")), "2") == 1
    expected = [("a", 2, "y", 1), ("b", 1, "z", 2), (None, 1, "n", 1)]
    assert stored(target, spark) == sorted(expected, key=repr)
    # The same load again, a load of nothing new, and an empty one change nothing.
    assert target.add(load(spark, ("a", 9, "z"), ("b", 1, "z"), (None, 5, "m")), "2") == 1
    assert target.add(load(spark, ("b", 7, "q")), "3") == 0
    assert target.add(load(spark), "4") == 0
    assert stored(target, spark) == sorted(expected, key=repr)


@pytest.mark.parametrize("blocks", [1, 1 << 19])
def test_full_and_joined_filters_stay_exact(spark, tmp_path, blocks):
    """One block lets everything through; more than may be sent to the executors are joined."""
    target = UniqueLoads(str(tmp_path), ["id", "day"], blocks=blocks)
    chance = random.Random(blocks)
    seen = {}
    for name in ("a", "b", "c"):
        values = {(str(chance.randrange(300)), chance.randrange(3), name) for _ in range(400)}
        target.add(load(spark, *values), name)
        for i, d, _ in values:
            seen.setdefault((i, d), name)
    assert {(i, d): n for i, d, _, n in stored(target, spark)} == seen


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    ids = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("id"))
    bloom = bloom_filter(ids.where("id < 'k5'"), ["id"], 1024)
    found = flagged(ids, ["id"], bloom, 1024).groupBy(F.expr("own.id < 'k5'").alias("old"), "possible").count().collect()
    n = {(r.old, r.possible): r["count"] for r in found}
    assert (True, False) not in n
    assert n.get((False, True), 0) < 0.05 * n[False, False]


def test_load_is_probed_before_any_shuffle(spark):
    ids = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    plan = flagged(ids, ["id"], bloom_filter(ids, ["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_drifting_fields_are_kept(spark, tmp_path):
    lines = [
        '{"id": 1, "v": 1.5}',
        '{"id": 2, "v": {"amount": 3}, "new": [1, 2]}',
        '{"id": "three", "v": null}',
        '{"id": 4',
        "[1, 2]",
        "null",
        "",
        "{}",
    ]
    path = tmp_path / "lines.json"
    path.write_text("\n".join(lines))
    found = typed(read_variant_lines(spark, str(path)), {"id": "bigint", "v": "double"})
    got = rows(found.select("id", "v", F.to_json("extra"), F.to_json("document"), "bad_line"))
    assert got == sorted(
        [
            (1, 1.5, "{}", '{"id":1,"v":1.5}', None),
            (2, None, '{"new":[1,2],"v":{"amount":3}}', '{"id":2,"new":[1,2],"v":{"amount":3}}', None),
            (None, None, '{"id":"three"}', '{"id":"three","v":null}', None),
            (None, None, None, None, '{"id": 4'),
            (None, None, None, None, "[1, 2]"),
            (None, None, None, None, "null"),
            (None, None, "{}", "{}", None),
        ],
        key=repr,
    )
    with pytest.raises(ValueError):
        typed(found, {"document": "string"})


def test_merged_sketches_are_within_their_error(spark):
    chance = random.Random(5)
    sizes = [("t", int(10 ** chance.uniform(0, 11))) for _ in range(3000)] + [("u", 0), ("u", 7), ("u", None)]
    gone = [("t", 10**6)] * 500 + [("w", 5)]
    frame = lambda part: size_sketch(spark.createDataFrame(part, "table string, length long"))
    merged = merge_sketches([frame(sizes[:900] + gone), frame(sizes[900:])], [frame(gone)])
    quantiles = (0.0, 0.01, 0.5, 0.999, 1.0)
    found = {(r.table, r.quantile): r for r in size_quantiles(merged, quantiles).collect()}
    assert {t for t, _ in found} == {"t", "u"}
    for name in ("t", "u"):
        exact = sorted(s for t, s in sizes if t == name and s is not None)
        for q in quantiles:
            size = exact[max(1, -int(-q * len(exact) // 1)) - 1]
            row = found[name, q]
            assert abs(row.bytes - size) <= ERROR * size * 1.000001
            assert (row.file_count, row.total_bytes) == (len(exact), sum(exact))
