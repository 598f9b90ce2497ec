"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Texts with the same words in a row are one text from then on (``sig``, a digest of the words).
2. Shingles are five words. Their document frequencies are counted over all documents in a
   sketch of fixed size, whose error is a small share of the number of documents; so is the
   share below which rarity no longer matters, so the weights mean the same at every size.
3. A weighted shingle set gets ``SAMPLES`` consistent samples: two sets agree in one with the
   probability of their weighted Jaccard similarity. Every ``ROWS`` of them make a bucket.
4. Within a bucket, sketches are compared; a spanning forest of what may be similar joins texts
   to families. Large buckets are cut into chunks, and every two chunks meet in a task.
5. Within a family the exact weighted Jaccard similarity decides. Families are cut in the same
   way. Again a spanning forest is enough: a pair that is connected already is not compared.
6. Connected components of the links are the classes; exact copies follow their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.common import over_batches, staged, whole
from lakeworks.llm.spans import WORD, Words, blocks, mixed

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Consistent samples of a text, and how many of them make a bucket.
SAMPLES = 36
ROWS = 3
#: Share of equal samples from which a pair is looked at: five deviations below the similarity.
PROMISING = 0.47
#: Sketch of document frequencies: tables and their width. Shingles in a smaller share of all
#: documents than ``RARE`` weigh the same.
TABLES = 4
WIDTH = 1 << 16
RARE = 0.01
#: Texts of a bucket, or of a family, that are in a task at once (twice as many where two chunks meet).
BUCKET_CHUNK = 4096
FAMILY_CHUNK = 512
#: Partial sketches that are added in one task.
FAN_IN = 64

_chance = np.random.default_rng(20240229)
_SEEDS = _chance.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_TABLE_SEEDS = _chance.integers(1, 2**63, TABLES, dtype=np.uint64)
# Gamma(2, 1) values for every 16-bit number, in a random order: the samples' random draws.
_GAMMA = np.maximum(_chance.gamma(2.0, 1.0, 1 << 16), 1e-6)
_LOG_GAMMA = np.log(np.maximum(_chance.gamma(2.0, 1.0, 1 << 16), 1e-6))


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text) and ``text``: id and key name a row, or equal rows."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, shingle, occurrences) of the distinct shingles by text, and each text's digest.

    A text of fewer than five words is one shingle; one without words has none.
    """
    words = Words(texts, WORD, lower=True)
    ends = np.cumsum(words.count)
    starts = ends - words.count
    digests = [
        hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())
    ]
    number = np.maximum(words.count - SHINGLE_WORDS + 1, np.minimum(words.count, 1))
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(starts, number)
    value = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE_WORDS):
        place = first + k
        inside = place < ends[owner]
        word = words.hash[np.minimum(place, max(0, len(words.hash) - 1))] if len(words.hash) else value
        value = mixed(value + np.where(inside, word, np.uint64(0)) + np.uint64(k + 1))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value))), digests


def _cells(value: np.ndarray, table: int) -> np.ndarray:
    return (mixed(value ^ _TABLE_SEEDS[table]) & np.uint64(WIDTH - 1)).astype(np.int64)


class Frequencies:
    """Shares of all documents that shingles occur in, from the summed sketch."""

    def __init__(self, counts: np.ndarray, documents: int):
        total = counts.sum(1, keepdims=True)
        # What a cell holds beyond its even part of all others.
        self.above = (counts - (total - counts) / (WIDTH - 1)).astype(np.float32)
        self.documents = max(1, documents)

    def weights(self, value: np.ndarray, times: np.ndarray) -> np.ndarray:
        """(1 + ln tf) * idf; idf falls from 2 (rare) to 1 (in every document)."""
        seen = np.min([self.above[t][_cells(value, t)] for t in range(TABLES)], axis=0)
        share = np.clip(seen / self.documents, RARE, 1)
        return (1 + np.log(times)) * (1 + np.log(share) / np.log(RARE))


def signatures(docs: DataFrame) -> tuple[DataFrame, Frequencies]:
    """``doc_id``, ``key`` and ``sig`` of every row, and the shingles' frequencies over all of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros((TABLES, WIDTH), np.int64), ["doc_id", "key", "sig", "counts"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digests: list[bytes] = []
            for some in blocks(texts):
                _, value, _, own = shingles(texts[some])
                digests += own
                for t in range(TABLES):
                    counts[t] += np.bincount(_cells(value, t), minlength=WIDTH)
            empty = pa.nulls(len(texts), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(digests, pa.binary()), empty], names
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i4").tobytes()])],
            names,
        )

    rows = staged(_texts(docs).mapInArrow(work, "doc_id long, key long, sig binary, counts binary"), "dedup-signatures")
    partial = rows.where(F.col("counts").isNotNull()).select("counts")

    def add(group: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x, "<i8" if len(x) == 8 * TABLES * WIDTH else "<i4") for x in group.column("counts").to_pylist()]
        total = np.sum(arrays, axis=0, dtype=np.int64)
        return pa.table({"counts": pa.array([total.astype("<i8").tobytes()])})

    # Sums of sums, a bounded number in each task, until one is left.
    left = partial.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        numbered = partial.withColumn("g", F.pmod(F.xxhash64("counts", F.monotonically_increasing_id()), F.lit(groups)))
        partial = staged(numbered.groupBy("g").applyInArrow(add, "counts binary"), "dedup-counts")
        left = partial.count() if groups > 1 else 1
    head = partial.head()
    size = 4 if head is None or len(head[0]) == 4 * TABLES * WIDTH else 8
    counts = np.frombuffer(head[0], f"<i{size}").reshape(TABLES, WIDTH) if head else np.zeros((TABLES, WIDTH))
    rows = rows.where(F.col("sig").isNotNull()).drop("counts")
    return rows, Frequencies(counts.astype(np.float64), rows.count())


def samples(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The consistent weighted samples of each text, 16 bits each; texts without shingles get zeros.

    For shingle and sample, r and c are drawn from Gamma(2, 1) and b evenly by the shingle's
    hash; with t = floor(ln w / r + b), the shingle with the smallest ln c - r (t - b + 1) is
    taken, and the sample is the shingle together with t.
    """
    result = np.zeros((texts, SAMPLES), np.uint16)
    if not len(owner):
        return result
    present, begin = np.unique(owner, return_index=True)
    length = np.diff(np.append(begin, len(owner)))
    log_weight = np.log(weight)
    low = np.uint64(0xFFFF)
    for k, seed in enumerate(_SEEDS):
        bits = mixed(value ^ seed)
        r = _GAMMA[bits & low]
        b = ((bits >> np.uint64(16)) & low) / 65536.0
        t = np.floor(log_weight / r + b)
        cost = _LOG_GAMMA[(bits >> np.uint64(32)) & low] - r * (t - b + 1)
        least = np.minimum.reduceat(cost, begin)
        at = np.flatnonzero(cost == np.repeat(least, length))
        first = at[np.searchsorted(at, begin)]
        pair = mixed(bits[first] ^ (t[first].astype(np.int64).view(np.uint64) << np.uint64(1)))
        result[present, k] = (pair >> np.uint64(48)).astype(np.uint16)
    return result


def sketches(docs: DataFrame, frequencies: Frequencies) -> DataFrame:
    """``sig``, ``sketch`` and ``buckets`` of each distinct text that has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        sigs, found, keep = [], [], []
        for some in blocks(texts):
            owner, value, times, own = shingles(texts[some])
            sigs += own
            found.append(samples(owner, value, shared.value.weights(value, times), len(own)))
            keep.append(np.isin(np.arange(len(own)), owner))
        sketch = np.concatenate(found)
        bands = sketch.reshape(len(sketch), -1, ROWS).astype(np.uint64)
        shift = np.uint64(16)
        keys = mixed(((bands[:, :, 0] << shift | bands[:, :, 1]) << shift | bands[:, :, 2]) + (np.arange(bands.shape[1], dtype=np.uint64) << np.uint64(48)))
        keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), keys.shape[1]).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary()), keys],
            ["sig", "sketch", "buckets"],
        ).filter(pa.array(np.concatenate(keep)))

    rows = over_batches(_texts(docs).select("text"), work, "sig binary, sketch binary, buckets array<long>")
    return rows.dropDuplicates(["sig"])


class Forest:
    """Which of the numbers 0..n-1 are connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether this connected two parts."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _chunked(rows: DataFrame, group: str, chunk: int, columns: list[str]) -> DataFrame:
    """Rows of every group with more than one row, as (``group``, ``low``, ``high``) and ``columns``.

    A group of up to ``chunk`` rows is one unit (0, 0); a larger one is dealt into chunks, and
    every two of them make a unit.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("sig"), chunks).cast("int")
    # A chunk meets every other; alone in its group, it meets itself.
    other = F.when(chunks == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), chunks - 1), lambda c: c != own)
    )
    return (
        rows.join(sizes, group)
        .withColumns({"own": own, "other": F.explode(other)})
        .select(group, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *columns)
    )


def _by_unit(rows: DataFrame, group: str) -> DataFrame:
    keys = [group, "low", "high"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sig")


def _units(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pd.DataFrame]:
    """The rows of each unit, from rows sorted by unit; a unit may lie across batches."""
    keys, rest = [group, "low", "high"], None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        same = (frame[keys] == frame[keys].iloc[-1]).all(axis=1)
        rest = frame[same]
        for _, unit in frame[~same].groupby(keys, sort=False):
            yield unit
    if rest is not None:
        yield rest


def _promising(unit: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs whose sketches agree enough."""
    sketch = np.frombuffer(b"".join(unit["sketch"]), np.uint16).reshape(len(unit), SAMPLES)
    forest, need = Forest(len(unit)), PROMISING * SAMPLES
    open_rows = np.arange(len(unit))
    for i in range(len(unit) - 1):
        later = open_rows[open_rows > i]
        for j in later[(sketch[later] == sketch[i]).sum(1) >= need].tolist():
            if forest.join(i, j):
                yield i, j


def families(sketched: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) between texts that share a bucket and may be similar."""
    members = sketched.select(F.explode("buckets").alias("bucket"), "sig", "sketch")
    units = _by_unit(_chunked(members, "bucket", BUCKET_CHUNK, ["sig", "sketch"]), "bucket")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, "bucket"):
            sigs = unit["sig"].tolist()
            links = [(sigs[i], sigs[j]) for i, j in _promising(unit)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"]
            )

    return units.mapInArrow(work, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """``sig`` and ``component`` (its smallest member) of everything that has a link.

    Every text points to the smallest it has seen; each round, neighbours and what they point
    to are passed on, so the distance to the smallest at least halves along a path of pointers.
    """
    both = staged(links.union(links.select("b", "a")).toDF("sig", "next").distinct(), "dedup-links")
    label = staged(
        both.groupBy("sig").agg(F.min("next").alias("n")).select("sig", F.least("sig", "n").alias("component")),
        "dedup-labels",
    )
    while True:
        # The smallest label next to each text, for itself and for the one it points to.
        near = both.join(label.withColumnRenamed("sig", "next"), "next").groupBy("sig").agg(F.min("component").alias("near"))
        joined = staged(label.join(near, "sig"), "dedup-near")
        hooks = joined.where(F.col("near") < F.col("component")).groupBy("component").agg(F.min("near").alias("hook"))
        if not hooks.head(1):
            return label
        own = joined.select("sig", F.least("component", "near").alias("low"), "component")
        hooked = own.join(hooks, "component", "left").select(
            "sig", F.least("low", F.coalesce("hook", F.col("low"))).alias("component")
        )
        hooked = staged(hooked, "dedup-hooked")
        jump = hooked.select(F.col("sig").alias("component"), F.col("component").alias("further"))
        label = staged(
            hooked.join(jump, "component", "left").select("sig", F.coalesce("further", "component").alias("component")),
            "dedup-labels",
        )


class Similarities:
    """Exact weighted Jaccard similarities among the texts of a unit, by an inverted index."""

    def __init__(self, texts: list[str], frequencies: Frequencies):
        parts, base = [], 0
        for some in blocks(texts):
            owner, value, times, _ = shingles(texts[some])
            parts.append((owner + base, value, frequencies.weights(value, times)))
            base += some.stop - some.start
        self.owner, self.value, self.weight = (np.concatenate([p[i] for p in parts]) for i in range(3))
        self.n = len(texts)
        self.total = np.bincount(self.owner, self.weight, self.n)
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))
        order = np.argsort(self.value, kind="stable")
        self.by_value = order
        ranked = self.value[order]
        # Where the postings of each shingle begin and end, for the shingles in text order.
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        stops = np.append(starts[1:], len(ranked))
        self.low, self.high = np.empty(len(ranked), np.int64), np.empty(len(ranked), np.int64)
        self.low[order], self.high[order] = starts[group], stops[group]

    def hub(self) -> int:
        """The text whose shingles the others share the most."""
        shared = np.bincount(self.owner, self.weight * (self.high - self.low), self.n)
        return int((shared / np.maximum(self.total, 1e-9)).argmax())

    def to(self, i: int) -> np.ndarray:
        own = slice(self.first[i], self.first[i + 1])
        low, size = self.low[own], self.high[own] - self.low[own]
        ends = np.cumsum(size)
        postings = self.by_value[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        smaller = np.minimum(self.weight[postings], np.repeat(self.weight[own], size))
        shared = np.bincount(self.owner[postings], smaller, self.n)
        return shared / np.maximum(self.total + self.total[i] - shared, 1e-9)


def _similar(texts: list[str], frequencies: Frequencies) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that reach the similarity.

    First everything is compared with the hub; what is connected to it need not be compared
    among itself, so only the others are then compared with all.
    """
    known, forest = Similarities(texts, frequencies), Forest(len(texts))
    hub = known.hub()
    for i in [hub, *(i for i in range(len(texts)) if i != hub)]:
        if i != hub and forest.root(i) == forest.root(hub):
            continue
        for j in np.flatnonzero(known.to(i) >= SIMILARITY - 1e-9).tolist():
            if j != i and forest.join(i, j):
                yield i, j


def links(docs: DataFrame, rows: DataFrame, family: DataFrame, frequencies: Frequencies) -> DataFrame:
    """Links (``a``, ``b``) between different texts of a family with the wanted similarity.

    Each text that is in a family is fetched once, from the row with its smallest id and key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)
    chosen = rows.groupBy("sig").agg(F.min(F.struct("doc_id", "key")).alias("row")).join(
        family.withColumnRenamed("component", "family"), "sig"
    )
    chosen = chosen.select("sig", "family", F.col("row.doc_id").alias("id"), F.col("row.key").alias("k"))
    texts = _texts(docs).join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    texts = staged(texts.select("sig", "family", "text"), "dedup-texts").dropDuplicates(["sig"])
    units = _by_unit(_chunked(texts, "family", FAMILY_CHUNK, ["sig", "text"]), "family")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, "family"):
            sigs = unit["sig"].tolist()
            found = [(sigs[i], sigs[j]) for i, j in _similar(unit["text"].tolist(), shared.value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"]
            )

    return units.mapInArrow(work, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``class_id`` (smallest ``doc_id`` of the class) and ``class_size`` of each row.

    Rows whose texts have the same words are in one class, among them all without any word
    (null, empty, punctuation only). Texts under five words are similar only to equal ones.
    Repeated rows are members of the same class. An empty table has no classes.
    """
    rows, frequencies = signatures(docs)
    sketched = staged(sketches(docs, frequencies), "dedup-sketches")
    family = components(families(sketched))
    linked = components(links(docs, rows, family, frequencies))
    known = rows.join(linked, "sig", "left").withColumn("class", F.coalesce("component", "sig"))
    smallest = known.groupBy("class").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("class_size")
    )
    return known.join(smallest, "class").select(
        "doc_id", "key", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.key").alias("class_key")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each class: the one with the smallest id and key.

    Of rows with the same id and text the one stays whose other columns, as JSON, come first.
    """
    found = staged(classes(docs), "dedup-classes")
    first = found.where(
        F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    )
    first = staged(first.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "dedup-kept")
    text = F.col("document.text")
    joined = whole(docs).join(
        first,
        F.col("document.doc_id").cast("long").eqNullSafe(F.col("doc_id"))
        & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("key")),
    )
    if not first.where("n > 1").head(1):
        return joined.select("document.*")
    # Rows that occur repeatedly are reduced to one; only these are shuffled.
    order = F.struct(F.to_json(F.col("document").dropFields("text")), text.isNull())
    repeated = joined.where("n > 1").groupBy("doc_id", "key").agg(F.min_by("document", order).alias("document"))
    return joined.where("n = 1").select("document.*").union(repeated.select("document.*"))
