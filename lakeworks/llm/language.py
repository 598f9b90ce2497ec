"""Language by the nearest of several centroids of each language.

A text becomes a vector of its n-grams: runs of one to four bytes of the lower-cased text, whose
non-letters are single spaces, counted in a fixed number of buckets, damped, weighted by inverse
document frequency and brought to length one. The texts of a language are clustered into several
centroids (one for prose, one for lists, and so on) by cosine; a text is given the language of the
centroid nearest to it. Each centroid knows how far its own texts lie from it, and what lies further
off than nearly all of them is marked as rejected.

Document frequencies are sums over all learning rows. Centroids come from a sample of bounded size of
each language, drawn by a hash of the text, so that copies of a text count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.llm.common import over_batches
from lakeworks.llm.spans import blocks

#: Lengths of the n-grams in bytes, and buckets they are counted in.
GRAMS = 4
BUCKETS = 4096
#: Texts of a language that its centroids come from, at most; languages, at most, most frequent first.
TRAINING_ROWS = 1024
LANGUAGES = 256
#: Centroids of a language and rounds that place them.
CENTROIDS = 4
ROUNDS = 10
#: Share of a centroid's own texts that lie within its limit.
WITHIN = 0.995
#: Bytes whose n-grams are counted at once.
CHUNK_BYTES = 1 << 21
#: What counts as a letter in a text.
LETTER = r"\p{L}"
UNKNOWN = "und"
DIGITS = 12

_CODES = np.arange(256)
_KEPT = np.where((_CODES >= 0x80) | ((_CODES >= 0x61) & (_CODES <= 0x7A)), _CODES, 0x20).astype(np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """``centroids`` are rows of length one; ``languages`` and ``limits`` say whose and how wide."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    limits: np.ndarray


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in each text."""
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for some in blocks(texts):
        coded = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts[some]]
        data = _KEPT[np.frombuffer(b"".join(coded), np.uint8)]
        lengths = np.array([len(c) for c in coded])
        starts = np.cumsum(lengths) - lengths
        space = data == 0x20
        kept = ~(space & np.concatenate([[False], space[:-1]]))
        kept[starts] = True
        owner = np.repeat(np.arange(some.start, some.start + len(coded), dtype=np.int32), lengths)[kept]
        data, space = data[kept], space[kept]
        for at in range(0, len(data), CHUNK_BYTES):
            counts += _chunk(data, space, owner, at, counts.size)
    return counts.reshape(len(texts), BUCKETS)


def _chunk(data: np.ndarray, space: np.ndarray, owner: np.ndarray, at: int, size: int) -> np.ndarray:
    """Counts of the n-grams that begin in one chunk and end in the same text."""
    stop = min(at + CHUNK_BYTES, len(data))
    code, keys = np.zeros(stop - at, np.uint64), []
    for n in range(1, GRAMS + 1):
        last = min(stop + n - 1, len(data))
        code = code[: last - n + 1 - at] * np.uint64(257) + data[at + n - 1 : last] + np.uint64(1)
        begin = slice(at, at + len(code))
        own = owner[begin] == owner[at + n - 1 : last]
        own &= ~(space[begin] & space[at + n - 1 : last]) if n < 3 else True
        bucket = (code * _FACTOR) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        keys.append((owner[begin].astype(np.int64) * BUCKETS + bucket.astype(np.int64))[own])
    return np.bincount(np.concatenate(keys), minlength=size)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a text without n-grams stays zero."""
    vectors = np.log1p(counts) * idf
    norm = np.sqrt((vectors**2).sum(1))
    return vectors / np.where(norm > 0, norm, 1)[:, None]


def clustered(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` centroids by cosine, and the distance within which most of their rows lie.

    The first is the row nearest to the mean, each further one the row farthest from those before.
    """
    mean = vectors.mean(0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(k, len(vectors)):
        nearest = (vectors @ vectors[chosen].T).max(1)
        if nearest.min() > 1 - 1e-9:
            break
        chosen.append(int(nearest.argmin()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(1)
        sums = np.array([vectors[own == c].sum(0) for c in np.unique(own)])
        centroids = sums / np.linalg.norm(sums, axis=1)[:, None]
    similar = vectors @ centroids.T
    own, distance = similar.argmax(1), 1 - similar.max(1)
    used = np.unique(own)
    return centroids[used], np.array([np.quantile(distance[own == c], WITHIN) for c in used])


def train(
    docs: DataFrame,
    learn_from: Column,
    rows: int = TRAINING_ROWS,
    languages: int = LANGUAGES,
    centroids: int = CENTROIDS,
) -> Model:
    """Learn from rows where ``learn_from`` holds, ``lang`` is not null and the text has a letter.

    Document frequencies count all of them. Centroids come from at most ``rows`` distinct texts of each
    of the ``languages`` most frequent values.
    """
    own = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    own = own.select(F.col("lang").cast("string").alias("lang"), "text")
    idf = _idf(own)
    hashed = own.withColumn("h", F.xxhash64("lang", "text"))
    found = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"))
    sizes = found.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return Model(idf, np.zeros((0, BUCKETS)), [], np.zeros(0))
    # A text is drawn if its hash lies below its language's rate; then copies are brought together.
    steps = 1 << 30
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(steps, rows * steps // r["texts"]))])
    drawn = hashed.where(F.pmod(F.col("h"), F.lit(steps)) < F.try_element_at(rate, F.col("lang")))
    texts = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = weighted(gram_counts(batch.column("text").to_pylist()), idf).astype("<f4")
        packed = pa.array([v.tobytes() for v in made], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), packed], ["lang", "h", "v"])

    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    bounded = over_batches(texts, vectors, "lang string, h long, v binary").withColumn("i", first)

    def place(group: pa.Table) -> pa.Table:
        packed = group.sort_by("h").column("v").to_pylist()
        own = np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1).astype(float)
        middle, limit = clustered(own, centroids, ROUNDS)
        lang = group.column("lang")[0].as_py()
        made = [v.astype("<f8").tobytes() for v in middle]
        return pa.table({"lang": [lang] * len(made), "c": range(len(made)), "v": made, "within": limit})

    placed = bounded.where(F.col("i") <= rows).drop("i").groupBy("lang").applyInArrow(
        place, "lang string, c long, v binary, within double"
    )
    known = sorted(placed.collect(), key=lambda r: (r["lang"], r["c"]))
    return Model(
        idf,
        np.array([np.frombuffer(r["v"], "<f8") for r in known]),
        [r["lang"] for r in known],
        np.array([r["within"] for r in known]),
    )


def _idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every bucket, over all rows; place -1 counts the rows."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start in range(0, len(texts), 500):
                counts = gram_counts(texts[start : start + 500])
                total[:BUCKETS] += (counts > 0).sum(0)
                total[BUCKETS] += len(counts)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    sums = docs.select("text").mapInArrow(holders, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS + 1)
    for row in sums.collect():  # one row per bucket
        total[row["place"]] = row["n"]
    return np.log((1 + total[BUCKETS]) / (1 + total[:BUCKETS])) + 1


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine with the nearest centroid) and ``rejected``.

    Texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing
    was learned; they count as rejected. Whatever else lies beyond its centroid's limit keeps the
    nearest language and is marked. Equal similarities go to the language that sorts first. Every
    row comes back once, repeated ones too; other columns are not looked at.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        readable = batch.column("readable").to_numpy(zero_copy_only=False).astype(bool)
        names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows = np.flatnonzero(readable)
        if len(rows) and len(model.languages):
            vectors = weighted(gram_counts([texts[i] for i in rows]), model.idf)
            similar = np.round(vectors @ model.centroids.T, DIGITS)
            nearest, best = similar.argmax(1), similar.max(1)
            for i, c in zip(rows.tolist(), nearest.tolist()):
                names[i] = model.languages[c]
            score[rows] = np.clip(best, 0, 1)
            rejected[rows] = 1 - best > model.limits[nearest]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"],
        )

    readable = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", readable.alias("readable"))
    rows = rows.withColumn("text", F.when(F.col("readable"), F.col("text")))
    return over_batches(rows, work, "doc_id long, lang_pred string, score double, rejected boolean")
