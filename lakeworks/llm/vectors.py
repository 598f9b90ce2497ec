"""What the two vector searches share: shards of vectors, blocks of queries, and their pairs.

A shard is one row: the index over its ids and vectors, built once and written. Rows are dealt to
shards by a hash of id and vector, so neither equal vectors of many ids nor many vectors of one id
meet in one; of equal rows ``k`` stand for all, as no query has more than ``k`` results. Queries are
packed into blocks in the same way, and every block meets every shard once; nothing is broadcast,
and a task holds one shard and one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.llm.common import staged


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vec`` (array<double>) of rows with an id and finite components only."""
    vec = F.col(vector).cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~odd
    )


def packed(
    rows: DataFrame, per_pack: int, name: str, payload: str, packing: Callable[[np.ndarray, np.ndarray], bytes]
) -> DataFrame:
    """Rows (``vec_id``, ``vec``) as packs (``name``, ``width``, ``payload``) of about ``per_pack`` rows.

    ``packing(ids, vectors)`` gets the pack's rows by ascending id, then by vector. Vectors of different lengths
    never share a pack (``width`` tells the length); the number of packs follows from a count.
    """
    packs = -(-rows.count() // per_pack) or 1
    dealt = rows.select(
        "*", F.size("vec").alias("width"), F.pmod(F.xxhash64("vec_id", "vec"), F.lit(packs)).alias(name)
    )

    def pack(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        values = group.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        # The order, and with it what is built, depends on the rows alone.
        order = np.lexsort((*values.T[::-1], ids))
        return pa.table(
            {
                name: group.column(name).slice(0, 1),
                "width": group.column("width").slice(0, 1),
                payload: pa.array([packing(ids[order], values[order])], pa.binary()),
            }
        )

    return dealt.groupBy(name, "width").applyInArrow(pack, f"{name} long, width int, {payload} binary")


def _together(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    return len(ids).to_bytes(8, "little") + ids.astype("<i8").tobytes() + vectors.astype("<f8").tobytes()


def _apart(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(value[:8], "little")
    ids = np.frombuffer(value, "<i8", n, 8)
    return ids, np.frombuffer(value, "<f8", offset=8 + 8 * n).reshape(n, -1)


def search(
    rows: DataFrame,
    is_query: Column,
    per_shard: int,
    per_block: int,
    build: Callable[[np.ndarray, np.ndarray], bytes],
    load: Callable[[bytes], object],
    find: Callable[[object, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, ...]]],
    k: int,
    score_type: str,
    best_first: Column,
) -> DataFrame:
    """The ``k`` best of every shard for every query, merged: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``build(ids, vectors)`` makes a shard's index, once, and ``load`` takes it from its written form;
    ``find(index, ids, vectors)`` yields arrays (query id, vector id, score) for a block of queries.
    """
    # Each of k equal rows, or fewer: more of them could not show among k results.
    copies = F.array_repeat(F.lit(True), F.least(F.count(F.lit(1)), F.lit(k)).cast("int"))
    rows = staged(
        rows.groupBy("vec_id", "vec").agg(copies.alias("copies")).select("vec_id", "vec", F.explode("copies")).drop("col"),
        "vectors",
    )
    shards = staged(packed(rows, per_shard, "shard", "built", build), "shards")
    blocks = staged(packed(rows.where(is_query), per_block, "block", "asked", _together), "blocks")
    n_blocks = blocks.agg(F.max("block")).head()[0]
    numbers = F.sequence(F.lit(0), F.lit(n_blocks or 0)).cast("array<long>")
    pairs = (
        shards.withColumn("block", F.explode(numbers))
        .join(blocks, ["block", "width"])
        .repartition("shard", "block")
        .sortWithinPartitions("shard", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if known != (row["shard"], row["width"]):
                    known, index = (row["shard"], row["width"]), load(row["built"])
                for found in find(index, *_apart(row["asked"])):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    ranked = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
