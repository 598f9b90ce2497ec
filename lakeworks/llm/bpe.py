"""Byte-pair encoding of whole texts, and decoding.

The vocabulary file is one of the ``tokenizers`` library: NFC, lower case, words by a pattern,
bytes as printable characters, merges with an end-of-word suffix. No pre-token contains white
space, so a text is cut at white space; a worker looks at every distinct chunk once, and encodes
every distinct word once. The merges run over a pair occurrence index: every pair of neighbouring symbols maps to all its
positions among the new words; the ranks that occur are taken in ascending order, all
positions of a pair are merged, and the lists of the pairs that arise are extended.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.common import id_and_text, list_array, over_batches
from lakeworks.llm.spans import NOT_SPACE, Words, blocks

#: Distinct chunks and distinct words a Python worker remembers; beyond, its memory starts afresh.
CHUNKS_REMEMBERED = 200_000
WORDS_REMEMBERED = 500_000

# White space beyond ASCII, which the cutting by bytes does not see.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, moved = [], 0
    for byte in range(256):
        table.append(chr(byte if byte in kept else 256 + moved))
        moved += byte not in kept
    return table


class Vocabulary:
    """What a vocabulary file says, ready for use."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or model["type"] != "BPE":
            raise ValueError(f"{path}: not a word vocabulary with NFC, lower case and no decoder")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.size = max([*self.ids.values(), *self.added.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.inner = [self.ids[c] for c in characters]
        self.final = [self.ids[c + self.suffix] for c in characters]
        self.merges: dict[int, int] = {}  # the pair's key -> its rank
        self.pairs: list[tuple[int, int, int]] = []  # by rank: left, right, merged
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = self.ids[left], self.ids[right]
            self.merges[a * self.size + b] = rank
            self.pairs.append((a, b, self.ids[left + right]))

    def words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks in a row, in normal form, and how many each chunk has."""
        text = "\n".join(chunks)
        found: list[str] = []
        for part in self.special.split(text) if "<" in text else [text]:
            if part in self.added:
                found.append(part)
            else:
                # Lower case by single characters: no final sigma.
                plain = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()
                found += self.pattern.findall(plain)
        breaks = [i for i, word in enumerate(found) if word == "\n"]
        counts = np.diff(np.array([-1, *breaks, len(found)])) - 1
        return [word for word in found if word != "\n"], counts

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all merged together through one pair occurrence index."""
        symbol: list[int] = []
        after: list[int] = []
        ends: list[int] = []
        for word in words:
            n = len(symbol)
            if word in self.added:
                symbol.append(self.added[word])
            else:
                data = word.encode("utf-8", "surrogatepass")
                symbol += [self.inner[b] for b in data[:-1]]
                symbol.append(self.final[data[-1]])
            after += range(n + 1, len(symbol))
            after.append(-1)
            ends.append(len(symbol))
        before = [-1] * len(symbol)
        where: dict[int, list[int]] = {}
        merges, size = self.merges, self.size
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                rank = merges.get(symbol[i] * size + symbol[j])
                if rank is not None:
                    where.setdefault(rank, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, merged = self.pairs[rank]
            for i in sorted(where.pop(rank)):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue  # a neighbour was merged meanwhile
                symbol[i], symbol[j] = merged, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b >= 0:
                        new = merges.get(symbol[a] * size + symbol[b])
                        if new is not None:
                            if new not in where:
                                where[new] = []
                                heapq.heappush(active, new)
                            where[new].append(a)
        result, start = [], 0
        for end in ends:
            result.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return result

    def decode(self, ids) -> str:
        """As the library does without a decoder: the tokens, one space between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Memory:
    """Ids of the distinct items seen so far, as flat arrays; ``encode`` fills in new ones."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.codes: dict = {}
        self.flat = np.empty(0, np.int32)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def known(self, items: list) -> np.ndarray:
        """The code of each of distinct items; new ones are encoded first."""
        new = [item for item in items if item not in self.codes]
        if new:
            self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
            flat, lengths = self.encode(new)
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.concatenate([self.start, starts])
            self.length = np.concatenate([self.length, lengths])
        return np.fromiter(map(self.codes.__getitem__, items), np.int64, len(items))

    def of(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all codes in a row, and how many each run of ``counts`` codes has."""
        lengths = self.length[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(self.start[codes] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.flat[places], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class TextMemory:
    """Ids of texts, by way of the distinct chunks and the distinct words met so far.

    ``encode_words`` takes new words and gives their ids in a row and the number of each.
    """

    def __init__(self, known: Vocabulary, encode_words):
        self.words = _Memory(encode_words)
        self.chunks = _Memory(lambda chunks: self._of_chunks(known, chunks))

    def _of_chunks(self, known: Vocabulary, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, counts = known.words([c.decode("utf-8", "surrogatepass") for c in chunks])
        distinct = list(dict.fromkeys(words))
        code = dict(zip(distinct, self.words.known(distinct).tolist()))
        return self.words.of(np.fromiter(map(code.__getitem__, words), np.int64, len(words)), counts)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        for memory, limit in ((self.chunks, CHUNKS_REMEMBERED), (self.words, WORDS_REMEMBERED)):
            if len(memory.codes) > limit:
                memory.clear()
        cut = Words([_WIDE_SPACE.sub(" ", t) if not t.isascii() else t for t in texts], NOT_SPACE)
        distinct, number = cut.distinct()
        return self.chunks.of(self.chunks.known(distinct)[number], cut.count)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> TextMemory:
    known = vocabulary(path)
    return TextMemory(known, lambda words: flattened(known.encode_words(words)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of each row's whole text.

    One row per input row, repeated rows included. A null or empty text, or one of white space
    alone, has no ids. The work is one pass without a shuffle; a lost task is simply run again.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory = _memory(path)
        texts = batch.column("text").to_pylist()
        parts = [memory.ids(texts[some]) for some in blocks(texts)]
        ids = np.concatenate([p[0] for p in parts])
        lengths = np.concatenate([p[1] for p in parts])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), list_array(ids, lengths)], ["doc_id", "ids"]
        )

    return over_batches(id_and_text(docs), work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of rows with ``doc_id`` and ``ids``; null ids decode to ""."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, column = vocabulary(path), batch.column("ids")
        texts = [known.decode(column[i].as_py() or []) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), column, pa.array(texts, pa.string())],
            ["doc_id", "ids", "decoded"],
        )

    return over_batches(rows.select("doc_id", "ids"), work, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``encode`` and then ``decode``, in one pass: ``doc_id``, ``ids``, ``decoded``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        memory, known = _memory(path), vocabulary(path)
        all_ids, all_lengths, decoded = [], [], []
        texts = batch.column("text").to_pylist()
        for some in blocks(texts):
            ids, lengths = memory.ids(texts[some])
            tokens, start = ids.tolist(), 0
            for end in np.cumsum(lengths).tolist():
                decoded.append(known.decode(tokens[start:end]))
                start = end
            all_ids.append(ids)
            all_lengths.append(lengths)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                list_array(np.concatenate(all_ids), np.concatenate(all_lengths)),
                pa.array(decoded, pa.string()),
            ],
            ["doc_id", "ids", "decoded"],
        )

    return over_batches(id_and_text(docs), work, "doc_id long, ids array<int>, decoded string")


def digests(rows: DataFrame) -> DataFrame:
    """Count and SHA-256 of the ids as decimal text, and SHA-256 of the decoded text."""
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
