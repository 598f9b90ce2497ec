"""Mixing sources to target weights, in blocks of words.

The words of a source, document after document, are cut into blocks of a fixed length. The
output is a number of shards; each draws how many blocks it takes of every source from a
multinomial distribution. The n-th block taken of a source is found by a pseudorandom
permutation of the source's block numbers, one per pass through the source, so no shuffle of the
corpus is needed: slots and blocks meet in a join by (source, block). What is drawn beyond a
source's quota is handed to the sources that were drawn too rarely, so every source delivers
its target to within a block, and none is read more than ``MOST_PASSES`` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.llm.common import staged, whole

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, blocks of an output shard, and how often a source may be read.
BLOCK_WORDS = 128
SHARD_BLOCKS = 65536
MOST_PASSES = 3
#: Documents of a source within which one running sum is taken, about.
BUCKET_ROWS = 2000
SEED = 20240229


def weights_in_turn(names: list[str | None]) -> dict[str | None, float]:
    """Weights 1, 2, 3, 1, ... over the names by code point, null last."""
    ordered = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n])
    return {name: 1.0 + i % 3 for i, name in enumerate(ordered + [None] * (None in names))}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float]) -> dict[str | None, float]:
    """Share all words by weight; what exceeds ``MOST_PASSES`` times a source is shared again."""
    left, open_names, result = float(sum(sizes.values())), set(sizes), {}
    while open_names:
        weight = sum(weights[n] for n in open_names)
        full = {n for n in open_names if left * weights[n] / weight > MOST_PASSES * sizes[n]}
        if not full:
            return result | {n: left * weights[n] / weight for n in open_names}
        result |= {n: float(MOST_PASSES * sizes[n]) for n in full}
        left -= sum(MOST_PASSES * sizes[n] for n in full)
        open_names -= full
    return result


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a Feistel network, walked until it lands inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    result = network(index.astype(np.uint64))
    while len(outside := np.flatnonzero(result >= size)):
        result[outside] = network(result[outside])
    return result.astype(np.int64)


@dataclass
class Mix:
    """``documents``: a row per document, keyed by (``s``, ``bucket``, ``n``), with ``doc_id``, ``tie``,
    ``size``, ``offset``, ``source_size`` and ``target``. ``slots``: ``shard``, ``s``, ``pass`` and ``block``
    of every block the mix takes."""

    documents: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """The documents' parts in blocks: their keys, ``block``, ``first`` (word of the document) and
        ``words``. Documents without words have one row with nulls."""
        first, last = F.col("offset"), F.col("offset") + F.col("size") - 1
        blocks = F.when(F.col("size") > 0, F.sequence(_block(first), _block(last)))
        rows = self.documents.withColumn("block", F.explode_outer(blocks))
        start = F.greatest(first, F.col("block") * BLOCK_WORDS)
        end = F.least(last + 1, (F.col("block") + 1) * BLOCK_WORDS)
        return rows.withColumns({"first": start - first, "words": end - start})

    def taken(self) -> DataFrame:
        """The documents with ``taken``, the words the mix takes of them, repeats counted."""
        times = self.slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
        kept = [F.first(c).alias(c) for c in ("doc_id", "tie", "size", "source_size", "target")]
        words = F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0)))
        return (
            self.pieces()
            .join(times, ["s", "block"], "left")
            .groupBy("s", "bucket", "n")
            .agg(*kept, words.alias("taken"))
        )


def _block(words: Column) -> Column:
    return F.floor(words / BLOCK_WORDS).cast("long")


def mix(docs: DataFrame, tie: Column | None = None) -> Mix:
    """Mix documents (``doc_id``, ``text``, ``source``) to the targets of ``weights_in_turn``.

    A word is a run of other than the six ASCII white-space characters; null texts have none. A
    null source is a source of its own, the last one. Repeated rows are documents of their own,
    with the same words in a row. The same rows give the same mix, however they are laid out.
    ``tie``, a hash of the text unless given, tells rows with one id apart.
    One row per source is kept on the driver; everything else stays in tables. An empty table
    or one without any word gives a mix without slots.
    """
    spark = docs.sparkSession
    base = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            (F.xxhash64(F.coalesce("text", F.lit(""))) if tie is None else tie).alias("tie"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    sizes = {r["source"]: r["size"] for r in found}
    goal = targets(sizes, weights_in_turn(list(sizes)))
    names = list(weights_in_turn(list(sizes)))
    blocks = [-(-sizes[n] // BLOCK_WORDS) for n in names]
    quota = [round(goal[n] * b / sizes[n]) if b else 0 for n, b in zip(names, blocks)]
    listed = spark.createDataFrame(
        [(s, n, sizes[n], goal[n]) for s, n in enumerate(names)],
        "s int, name string, source_size long, target double",
    )
    buckets = max(1, -(-sum(r["rows"] for r in found) // BUCKET_ROWS))
    keyed = base.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets))
    )
    within = Window.partitionBy("s", "bucket").orderBy("doc_id", "tie")
    before = Window.unboundedPreceding
    ahead = keyed.groupBy("s", "bucket").agg(F.sum("size").alias("words")).select(
        "s",
        "bucket",
        F.coalesce(
            F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(before, -1)), F.lit(0)
        ).alias("ahead"),
    )
    documents = (
        keyed.select(
            "*",
            F.row_number().over(within).alias("n"),
            F.coalesce(F.sum("size").over(within.rowsBetween(before, -1)), F.lit(0)).alias("local"),
        )
        .join(ahead, ["s", "bucket"])
        .withColumn("offset", F.col("ahead") + F.col("local"))
        .drop("local", "ahead", "name", "source")
    )
    # Written out, so that the planner sees the size of what _expand makes of a few runs.
    slots = staged(_slots(spark, np.array(quota, np.int64), np.array(blocks, np.int64)), "mix-slots")
    return Mix(staged(documents, "mix-documents"), slots)


def _slots(spark, quota: np.ndarray, blocks: np.ndarray) -> DataFrame:
    total = int(quota.sum())
    shards = -(-total // SHARD_BLOCKS)
    drawn = spark.range(shards).mapInPandas(
        lambda frames: _draw(frames, quota, total), "shard long, s int, count long"
    )
    drawn = staged(drawn, "mix-draws")
    by_shard = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    limits = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)], "s int, quota long")
    placed = drawn.join(F.broadcast(limits), "s").withColumn(
        "first", F.coalesce(F.sum("count").over(by_shard), F.lit(0))
    )
    kept = F.greatest(F.lit(0), F.least(F.col("count"), F.col("quota") - F.col("first")))
    placed = placed.withColumn("kept", kept)
    # What came too often, numbered over all shards, fills the gaps of what came too rarely.
    totals = {r["s"]: r["kept"] for r in placed.groupBy("s").agg(F.sum("kept").alias("kept")).collect()}
    have = np.array([totals.get(i, 0) for i in range(len(quota))], np.int64)
    over_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    surplus = (
        placed.groupBy("shard")
        .agg(F.sum(F.col("count") - F.col("kept")).alias("count"))
        .withColumn("first", F.coalesce(F.sum("count").over(over_shards), F.lit(0)))
    )
    filled = surplus.mapInPandas(
        lambda frames: _fill(frames, quota - have, have), "shard long, s int, first long, kept long"
    )
    runs = placed.select("shard", "s", "first", "kept").unionByName(filled).where("kept > 0")
    return runs.repartition("shard", "s").mapInArrow(
        lambda batches: _expand(batches, blocks), "shard long, s int, pass int, block long"
    )


def _draw(frames: Iterator[pd.DataFrame], quota: np.ndarray, total: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for shard in frame["id"]:
            slots = min(SHARD_BLOCKS, total - shard * SHARD_BLOCKS)
            counts = np.random.default_rng([SEED, shard]).multinomial(slots, quota / total)
            yield pd.DataFrame({"shard": shard, "s": np.arange(len(quota), dtype=np.int32), "count": counts})


def _fill(frames: Iterator[pd.DataFrame], missing: np.ndarray, have: np.ndarray) -> Iterator[pd.DataFrame]:
    """Cut each shard's surplus numbers along the gaps of the sources."""
    ends = np.cumsum(missing)
    for frame in frames:
        for shard, count, first in zip(frame["shard"], frame["count"], frame["first"]):
            low = np.maximum(ends - missing, first)
            some = np.minimum(ends, first + count) - low
            s = np.flatnonzero(some > 0)
            yield pd.DataFrame(
                {
                    "shard": shard,
                    "s": s.astype(np.int32),
                    "first": have[s] + low[s] - (ends - missing)[s],
                    "kept": some[s],
                }
            )


def _expand(batches: Iterator[pa.RecordBatch], blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per slot: the n-th slot of a source is in pass n // blocks, at a permuted block."""
    for batch in batches:
        for row in batch.to_pylist():
            order = np.arange(row["first"], row["first"] + row["kept"])
            size = int(blocks[row["s"]])
            turn, place = np.divmod(order, size)
            block = np.empty(len(order), np.int64)
            for t in np.unique(turn):
                here = turn == t
                block[here] = permuted(place[here], size, SEED + 1000 * row["s"] + int(t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(order), row["shard"])),
                    pa.array(np.full(len(order), row["s"], np.int32)),
                    pa.array(turn.astype(np.int32)),
                    pa.array(block),
                ],
                ["shard", "s", "pass", "block"],
            )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: what each pass takes of a document.

    ``text`` holds the taken words in order, white space between neighbours kept; ``n_chars``, if
    there, is set anew. A document taken whole in a pass is unchanged; one that is not taken at
    all is gone; one taken in three passes has three rows. Documents without words have no part
    in a mix and are gone too. Rows with one id and text that differ in any other column, their source
    among them, are documents of their own.
    """
    columns = docs.columns
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]))
    own = F.xxhash64(F.coalesce("text", F.lit("")), others)
    plan = mix(docs, own)
    parts = (
        plan.pieces()
        .join(plan.slots.select("s", "block", "pass"), ["s", "block"])
        .groupBy("doc_id", "tie", "s", "bucket", "n", "pass")
        .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"), F.first("size").alias("size"))
    )
    parts = parts.select("doc_id", "tie", "parts", "size")
    texts = whole(docs, F.col("doc_id").cast("long").alias("id"), own.alias("own"))
    if _has_repeats(plan.documents):
        texts = texts.dropDuplicates(["id", "own"])  # equal rows; each copy has parts of its own
    once = parts.join(texts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("tie") == F.col("own")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(WORD)
        for batch in batches:
            texts, own = [], dict(zip(columns, batch.column("document").flatten()))
            parts_of, sizes = batch.column("parts").to_pylist(), batch.column("size").to_pylist()
            for text, parts, size in zip(own["text"].to_pylist(), parts_of, sizes):
                if sum(p["words"] for p in parts) < size:
                    starts = [m.start() for m in word.finditer(text)] + [len(text)]
                    texts.append("".join(text[starts[p["first"]] : starts[p["first"] + p["words"]]] for p in parts).rstrip())
                else:
                    texts.append(text)
            arrays = [pa.array(texts, pa.string()) if c == "text" else own[c] for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    result = once.select("document", "parts", "size").mapInArrow(cut, docs.schema)
    return result.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else result


def _has_repeats(documents: DataFrame) -> bool:
    return bool(documents.groupBy("doc_id", "tie").count().where("count > 1").head(1))
