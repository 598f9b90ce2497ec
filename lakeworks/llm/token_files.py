"""Token ids as Parquet files that can be read in part.

A row is a document: its id, its place, its length and the ids as a list column, in ascending
order of the ids of the documents over all files. Lists are dictionary encoded (delta encoded
where the dictionary grows too large, by the writer's second format version), in row groups and pages of a set
size with page indexes, so a reader can fetch the columns about documents without the ids, and
the ids of some documents without the rest.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeworks.llm.bpe import _WIDE_SPACE, WORDS_REMEMBERED, TextMemory, Vocabulary, vocabulary
from lakeworks.llm.common import id_and_text, list_array, over_batches
from lakeworks.llm.spans import NOT_SPACE, Words, blocks

#: Fixed values of the format.
END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
#: Text bytes that one file's task takes, about.
FILE_TEXT_BYTES = 16 << 20


#: Words given to the library in one string, and strings at a time.
WORDS_JOINED = 200
STRINGS_AT_ONCE = 50


#: Repeated chunks that a worker remembers, at most about.
REPEATED_CHUNKS = 300_000
#: Text bytes that are encoded together, about: what a worker holds beside its memory is some 50 times that.
TEXTS_AT_ONCE = 1 << 20
#: Places of the filter that says which chunks were met before.
SEEN_PLACES = 1 << 22


class RepeatedMemory(TextMemory):
    """A memory of the chunks that were met twice, in one block of texts or in two.

    Most distinct chunks never come back; kept out, they do not push out those that do. What was
    met before is a filter over hashes: where it errs, a chunk is remembered too early.
    """

    def __init__(self, known: Vocabulary, encode_words):
        super().__init__(known, encode_words)
        self.seen = np.zeros(SEEN_PLACES, bool)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        memory = self.chunks
        for some, limit in ((memory, REPEATED_CHUNKS), (self.words, WORDS_REMEMBERED)):
            if len(some.codes) > limit:
                some.clear()
        cut = Words([_WIDE_SPACE.sub(" ", t) if not t.isascii() else t for t in texts], NOT_SPACE)
        distinct, number = cut.distinct()
        place = np.zeros(len(distinct), np.int64)
        place[number] = (cut.hash & np.uint64(SEEN_PLACES - 1)).astype(np.int64)
        again = (np.bincount(number, minlength=len(distinct)) > 1) | self.seen[place]
        if np.count_nonzero(self.seen) > SEEN_PLACES // 2:
            self.seen[:] = False
        self.seen[place] = True
        code = np.fromiter(map(memory.codes.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(code < 0)
        letters = np.fromiter(map(bytes.isalpha, map(distinct.__getitem__, new.tolist())), bool, len(new))
        # Those to remember first; among both, chunks of ASCII letters, which are words as they stand.
        groups = [new[kept & plain] for kept in (again[new], ~again[new]) for plain in (letters, ~letters)]
        encoded = [(np.empty(0, np.int32), np.empty(0, np.int64))]
        for group, plain in zip(groups, (True, False, True, False)):
            if len(group):
                chunks = [distinct[i] for i in group.tolist()]
                encoded.append(self._plain(chunks) if plain else memory.encode(chunks))
        flat, lengths = (np.concatenate(x) for x in zip(*encoded))
        new, kept = np.concatenate(groups), len(groups[0]) + len(groups[1])
        code[new] = len(memory.start) + np.arange(len(new))
        size = int(lengths[:kept].sum())
        starts = len(memory.flat) + np.cumsum(lengths) - lengths
        memory.codes.update(zip(map(distinct.__getitem__, new[:kept].tolist()), code[new[:kept]].tolist()))
        before = len(memory.flat), len(memory.start)
        memory.flat = np.concatenate([memory.flat, flat])
        memory.start = np.concatenate([memory.start, starts])
        memory.length = np.concatenate([memory.length, lengths])
        found = memory.of(code[number], cut.count)
        memory.flat = memory.flat[: before[0] + size]
        memory.start, memory.length = memory.start[: before[1] + kept], memory.length[: before[1] + kept]
        return found

    def _plain(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that are one word each."""
        words = b" ".join(chunks).lower().decode().split(" ")
        self.words.known(list(dict.fromkeys(words)))
        codes = np.fromiter(map(self.words.codes.__getitem__, words), np.int64, len(words))
        return self.words.of(codes, np.ones(len(words), np.int64))


@lru_cache(maxsize=2)
def _memory(path: str) -> TextMemory:
    """Ids by the ``tokenizers`` library.

    It gets the distinct new words with spaces between them; the token that ends a word says
    where the next one begins.
    """
    # A task has one core: threads of the library's own would take turns on it, each with memory of its own.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known, tokenizer = vocabulary(path), Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    last = np.array([t.endswith(known.suffix) or t in known.added for t in known.tokens])

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, step = [np.empty(0, np.int32)], WORDS_JOINED * STRINGS_AT_ONCE
        for start in range(0, len(words), step):
            some = words[start : start + step]
            joined = [" ".join(some[i : i + WORDS_JOINED]) for i in range(0, len(some), WORDS_JOINED)]
            parts += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(parts)
        lengths = np.diff(np.flatnonzero(last[ids]), prepend=-1)
        if len(lengths) != len(words):
            raise ValueError("the library's words differ from the pattern's")
        return ids, lengths

    return RepeatedMemory(known, encode)


def tokenized(docs: DataFrame, path: str, partitions: int) -> DataFrame:
    """``doc_id``, ``part``, ``n_tokens`` and ``ids`` (end id included), ordered by ``doc_id``.

    Rows are dealt into ranges of (``doc_id``, hash of the text), so that even one id with a
    third of all rows is split; equal ids are ordered by their text. Null ids come first.
    """
    dealt = (
        id_and_text(docs)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory, texts = _memory(path), batch.column("text").to_pylist()
        parts, lengths = [], []
        for some in blocks(texts, TEXTS_AT_ONCE):
            ids, counts = memory.ids(texts[some])
            parts.append(np.insert(ids, np.cumsum(counts), END_ID))
            lengths.append(counts + 1)
        counts = np.concatenate(lengths)
        part = np.full(len(texts), TaskContext.get().partitionId(), np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(part), pa.array(counts), list_array(np.concatenate(parts), counts)],
            ["doc_id", "part", "n_tokens", "ids"],
        )

    return over_batches(dealt, work, "doc_id long, part int, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, text_bytes: int) -> None:
    """Encode and write. ``text_bytes`` is the size of the input, from which the files follow."""
    partitions = max(1, -(-text_bytes // FILE_TEXT_BYTES))
    (
        tokenized(docs, vocabulary, partitions)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "v2")
        .option("parquet.column.index.truncate.length", 64)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``position``, the place of a row in its file.

    A file of one task is cut into several splits; the place within the part comes from the
    file's own row order.
    """
    return spark.read.parquet(path).select(
        "doc_id", "part", "n_tokens", "ids", F.col("_metadata.row_index").alias("position")
    )


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``position`` and ``start`` (ids of all documents before) of each row.

    Reads the lengths alone. Running sums are taken in two steps: over parts, of which there is
    one row each, and within each part, whose size the writer bounds.
    """
    rows = spark.read.parquet(path).select(
        "part", "n_tokens", F.col("_metadata.row_index").alias("position")
    )
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select(
        "part", "position", (F.col("part_start") + F.col("before")).alias("start")
    )


def checksums(rows: DataFrame) -> DataFrame:
    """The rows with ``ids_crc32`` over the ids as little-endian 32-bit integers, without the ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("ids")
        values = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), "<u4").data.cast("B")
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        sums, start = [], 0
        for end in ends:
            sums.append(zlib.crc32(values[4 * start : 4 * end]))
            start = end
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "part", "position", "n_tokens")] + [pa.array(sums, pa.int64())],
            ["doc_id", "part", "position", "n_tokens", "ids_crc32"],
        )

    return over_batches(
        rows.select("doc_id", "part", "position", "n_tokens", "ids"),
        work,
        "doc_id long, part int, position long, n_tokens long, ids_crc32 long",
    )
