from __future__ import annotations

import hashlib
import math

import numpy as np
from compare import differences, duckdb_over

from lakeworks.llm import centroids
from lakeworks.llm.queries import op13_centroids

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k, rounds, width, scale):
    """Python integers throughout, every vector with every centroid."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept]
    middle = [v for *_, v in sorted(key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(middle)):
            held = [v for (_, v), c in zip(kept, own) if c == n]
            if held:
                middle[n] = [sum(x) // len(held) for x in zip(*held)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    per = [sum(d for _, c, d in out if c == n) for n in range(len(middle))]
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, per[c], sum(per), text[c]) for i, c, d in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_brute_force_with_odd_rows_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in middles[i % 5] + rng.normal(size=6) * 0.3]) for i in range(400)]
    rows += [(7, [0.5] * 6)] * 60  # a hot id and vector
    rows += [(None, [0.25] * 6), (None, [0.25] * 6), (900, [-0.0] * 6)]
    odd = [(901, None), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [math.nan] * 6), (905, [math.inf] * 6), (906, [])]
    for k, leading in ((8, 2), (3, 6), (20, 1)):
        made = centroids.cluster(frame(spark, rows + odd).repartition(5), k, 4, 6, 64, leading)
        assert found(made) == brute(rows, k, 4, 6, 64)


def test_equal_distances_go_to_the_smaller_number():
    centres = np.array([[2, 0], [0, 0], [2, 0]])
    v = np.array([[1, 0], [2, 0], [0, 0]])
    turn = np.eye(2)
    cluster, distance, _ = centroids.nearest(v, *centroids.rotated(v, turn, 1), centres, turn)
    assert cluster.tolist() == [0, 0, 1] and distance.tolist() == [1, 0, 0]


def test_bounds_spare_comparisons_and_never_change_the_result():
    rng = np.random.default_rng(2)
    base = np.linalg.qr(rng.normal(size=(32, 32)))[0] * np.geomspace(3000, 10, 32)
    middles = rng.normal(size=(24, 32)) @ base.T
    v = np.floor(middles[rng.integers(24, size=3000)] + rng.normal(size=(3000, 32)) @ base.T * 0.1).astype(np.int64)
    turn = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    c = np.floor(middles).astype(np.int64)
    cluster, distance, compared = centroids.nearest(v, *centroids.rotated(v, turn, 8), c, turn)
    full = ((v[:, None, :] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert compared < 0.15 * full.size


def test_bounds_hold_for_the_largest_components():
    rng = np.random.default_rng(3)
    top = centroids.LARGEST
    v = rng.integers(-top, top, size=(200, 64))
    c = v[:8] + rng.integers(-1, 2, size=(8, 64))
    turn = np.linalg.eigh(np.cov(v.astype(float).T))[1][:, ::-1]
    cluster, distance, _ = centroids.nearest(v, *centroids.rotated(v, turn, 16), c, turn)
    full = [[sum(int(a - b) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert distance.tolist() == [min(f) for f in full]
    assert cluster.tolist() == [f.index(min(f)) for f in full]


def test_beyond_the_largest_component_fewer_vectors_than_clusters_and_empty_tables(spark):
    huge = [(1, [1e300, 0.0]), (2, [float(centroids.LARGEST), 0.0])]
    rows = [(3, [1.0, 2.0]), (4, [1.0, 2.0])]
    assert found(centroids.cluster(frame(spark, rows + huge), 8, 3, 2, 64)) == brute(rows, 8, 3, 2, 64)
    assert found(centroids.cluster(frame(spark, huge), 8, 3, 2, 64)) == []
    assert found(centroids.cluster(frame(spark, []), 8, 3, 2, 64)) == []


def test_clashing_columns_change_nothing(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(40)]
    plain = frame(spark, rows)
    named = plain.selectExpr("*", "1 AS v", "2 AS vec", "3 AS cluster", "4 AS distance", "5 AS lead", "6 AS place")
    assert found(centroids.cluster(named, 4, 3, 2, 64)) == found(centroids.cluster(plain, 4, 3, 2, 64))


def test_query_equals_its_sql(spark):
    assert not differences(op13_centroids(spark, SF), duckdb_over(SF), centroids.SQL)
