"""Exact k-means over integer vectors; a PCA rotation rules most centroids out.

The vectors' covariance, summed over all rows, gives a rotation whose leading coordinates hold most
of the spread. Every vector is stored once with these coordinates and the norm of what is left. For
a centroid rotated in the same way, the squared distance of the leading coordinates plus the
squared difference of the residual norms is never above the squared distance. A vector is compared in
full, in integers, with the centroid of the smallest bound and with those whose bound does not
exceed that distance; so the clusters do not depend on the rotation or on its rounding.

A round is one pass over the stored vectors that keeps sums per task: neither vectors nor copies of
a vector meet in one task, and what reaches the driver is one sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.common import BATCH_ROWS, staged

#: Fixed values of the query: components of a vector, their scale, clusters, rounds, and the prefix
#: of an id whose digest orders the vectors that clusters start from.
WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
START_PREFIX = "3:"
#: Leading rotated coordinates that are stored with a vector.
LEADING = 16
#: Largest scaled component: up to it squared distances of vectors of 64 components fit 64 bits.
LARGEST = 1 << 27
#: Relative rounding error granted to a bound before it rules a centroid out.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v`` (array<int>, floor(scale * x)) of the rows that take part."""
    vec = F.col(vector).cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) > LARGEST))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec").isNotNull() & (F.size("vec") == width) & ~odd
    ).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """A column of equally long binaries as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, by falling variance over all vectors; sums of products, one per pair."""
    upper = np.triu_indices(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in _parts(batches):
            v = batch.column("v").flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
            n, total, products = n + len(v), total + v.sum(0), products + v.T @ v
        if n:
            values = np.concatenate([[float(n)], total, products[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    sums = vectors.select("v").mapInArrow(moments, "place long, value double").groupBy("place").agg(F.sum("value"))
    found = dict(sums.collect())
    if not found:
        return np.eye(width)
    values = np.array([found[i] for i in range(len(found))])
    mean = values[1 : width + 1] / values[0]
    products = np.zeros((width, width))
    products[upper] = values[width + 1 :] / values[0]
    products = np.triu(products) + np.triu(products, 1).T
    return np.linalg.eigh(products - np.outer(mean, mean))[1][:, ::-1]


def rotated(vectors: np.ndarray, turn: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of each row, and the norm of the others."""
    coordinates = vectors.astype(float) @ turn
    return coordinates[:, :leading], np.sqrt((coordinates[:, leading:] ** 2).sum(1))


def stored(vectors: DataFrame, turn: np.ndarray, leading: int) -> DataFrame:
    """Vectors with their leading coordinates and residual norm, written once for all rounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            lead, rest = rotated(v, turn, leading)
            columns = [[row.tobytes() for row in v.astype("<i4")], [row.tobytes() for row in lead.astype("<f8")]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), *[pa.array(c, pa.binary()) for c in columns], pa.array(rest)],
                ["vec_id", "v", "lead", "rest"],
            )

    return staged(vectors.mapInArrow(work, "vec_id long, v binary, lead binary, rest double"), "vectors")


def nearest(
    v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of each row, and the full comparisons made."""
    c_lead, c_rest = rotated(centroids, turn, lead.shape[1])
    own, theirs = (lead**2).sum(1), (c_lead**2).sum(1)
    bound = own[:, None] + theirs - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    slack = SLACK * ((own + rest**2)[:, None] + theirs + c_rest**2) + 1e-6

    def squared(rows: np.ndarray, numbers) -> np.ndarray:
        gap = v[rows].astype(np.int64) - centroids[numbers]
        return (gap * gap).sum(1)

    everyone = np.arange(len(v))
    first = bound.argmin(1)
    reached = squared(everyone, first)
    open_ = bound - slack <= reached[:, None]
    best, cluster, compared = reached.copy(), first.copy(), len(v)
    for number in range(len(centroids)):
        rows = everyone[open_[:, number] & (first != number)]
        compared += len(rows)
        distance = squared(rows, number)
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (number < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = distance[nearer], number
    return cluster, best, compared


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v, lead = _matrix(batch.column("v"), "<i4"), _matrix(batch.column("lead"), "<f8")
    cluster, distance, _ = nearest(v, lead, batch.column("rest").to_numpy(), centroids, turn)
    return v, cluster, distance


def moved(vectors: DataFrame, centroids: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; empty ones stay."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)  # the last column counts
        for batch in _parts(batches):
            v, cluster, _ = _assigned(batch, centroids, turn)
            order = np.argsort(cluster, kind="stable")
            numbers, first = np.unique(cluster[order], return_index=True)
            total[numbers, :width] += np.add.reduceat(v[order].astype(np.int64), first, axis=0)
            total[numbers, width] += np.diff(first, append=len(order))
        number, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), pa.array(place), pa.array(total[number, place])], ["number", "place", "value"]
        )

    found = vectors.mapInArrow(sums, "number long, place long, value long")
    total = np.zeros((k, width + 1), np.int64)
    for row in found.groupBy("number", "place").agg(F.sum("value").alias("value")).collect():
        total[row["number"], row["place"]] = row["value"]
    filled = total[:, width] > 0
    out = centroids.copy()
    out[filled] = total[filled, :width] // total[filled, width:]
    return out


def starts(vectors: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests; ties by components, null ids last."""
    digest = F.sha2(F.concat(F.lit(START_PREFIX), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    rows: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    leading: int = LEADING,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` and what its cluster and all clusters come to.

    Vectors with ``width`` components, none of them null, non-finite or beyond ``LARGEST / scale``, take
    part; others give no row. Repeated rows count, and come back, as often as they occur; a null id
    keeps its row. Equal distances go to the smaller centroid. With fewer than ``k`` vectors there
    are as many centroids as vectors; an empty table gives no rows. Sums that do not fit 64 bits
    come back as null. Other columns are not looked at.
    """
    vectors = integer_vectors(rows, width=width, scale=scale)
    turn = rotation(vectors, width)
    centroids = starts(vectors, k, width)
    known = stored(vectors, turn, min(leading, width))
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(known, centroids, turn)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            _, number, distance = _assigned(batch, centroids, turn)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    done = staged(known.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters")
    wide = F.col("distance").cast("decimal(38,0)")
    inertia = {r["cluster"]: int(r["n"]) for r in done.groupBy("cluster").agg(F.sum(wide).alias("n")).collect()}

    def fitting(value: int):
        return F.lit(value if value < 1 << 63 else None).cast("long")

    # One entry per centroid, so its size is known.
    of_cluster = F.array(
        *[
            F.struct(fitting(inertia.get(i, 0)).alias("inertia"), F.lit(digest(c)).alias("sha256"))
            for i, c in enumerate(centroids)
        ]
        or [F.struct(fitting(0).alias("inertia"), F.lit("").alias("sha256"))]
    )
    own = of_cluster[F.col("cluster")]
    return done.select(
        "vec_id",
        "cluster",
        "distance",
        own["inertia"].alias("cluster_inertia"),
        fitting(sum(inertia.values())).alias("inertia"),
        own["sha256"].alias("centroid_sha256"),
    )


def _sql() -> str:
    """The same clusters, round by round, in SQL."""
    gap = "list_sum(list_transform(k.v, lambda x, i: (x - c.v[i]) * (x - c.v[i])))"
    steps = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{START_PREFIX}' || vec_id), v) - 1 AS c, v FROM k
  ORDER BY sha256('{START_PREFIX}' || vec_id), v LIMIT {CLUSTERS})"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, any_value(kv) AS v, min({{'d': d, 'c': c}}) AS m
  FROM (SELECT k.r, k.vec_id, k.v AS kv, c.c, {gap}::BIGINT AS d FROM k, c{i} c) GROUP BY r, vec_id)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} AS (
  SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY c) n ON n.c = c.c)"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance,
  (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.m.c
"""


SQL = _sql()
