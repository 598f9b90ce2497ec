"""Ranked lexical search: short lists summed term at a time, long ones met document at a time.

The documents are indexed in shards: for each term that some query uses, the ascending documents that
hold it and how often. Statistics are sums over all shards. In a shard, a query's short lists are
summed into accumulators first. From then on the accumulators are one more posting list: ascending
documents with scores, and a largest score per block of documents. The search then goes through
the documents in ascending order, over this list and the long ones. Windows whose block bounds do
not reach the k-th best score are skipped; in the others candidates come from the lists without
which no document can reach it, and the remaining lists are only looked up at candidates, until
their bounds rule these out. A task carries its k best from shard to shard; the tasks' results are
merged by rank.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.llm.common import BATCH_ROWS, staged
from lakeworks.llm.spans import WORD, Words, blocks

#: A term's characters and the letters that are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and postings of a shard, at most.
SHARD_DOCS = 16384
SHARD_POSTINGS = 1 << 21
#: Documents that share a bound, and blocks that are looked at together.
BLOCK_DOCS = 128
WINDOW_BLOCKS = 16
#: A list is short if it holds at most one in so many documents of the shard.
SHORT_SHARE = 32
#: Terms of the queries that go through the documents together, about; more queries, more passes.
QUERY_TERMS = 1 << 18
#: Characters of a text that are cut into words at once, about.
PIECE_CHARS = 1 << 20

_SEPARATOR = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and each distinct ``term`` of the texts that carry it."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def _pieces(text: str) -> Iterator[str]:
    """A long text cut between words."""
    start = 0
    while len(text) - start > PIECE_CHARS and (cut := _SEPARATOR.search(text, start + PIECE_CHARS)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _postings(texts: list[str], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts in terms; and document, known term and occurrences of each posting."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        own = list(_pieces(text)) if len(text) > PIECE_CHARS else [text]
        pieces += own
        owner += [i] * len(own)
    owner, length, keys = np.array(owner, np.int64), np.zeros(len(texts), np.int64), [np.empty(0, np.int64)]
    for some in blocks(pieces):
        words = Words(pieces[some], WORD, lower=True)
        distinct, number = words.distinct()
        np.add.at(length, owner[some], words.count)
        term = np.array([known.get(w, -1) for w in distinct], np.int64)[number]
        doc = np.repeat(owner[some], words.count)
        keys.append((doc * len(known) + term)[term >= 0])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return length, *np.divmod(key, max(len(known), 1)), count


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Shards with the postings of ``terms``: one row each, written to the shared folder.

    ``ids``, ``absent`` (null ids) and ``lengths`` describe the documents, which ascend by id with
    null ids last; documents without a term are left out. ``terms`` and ``counts`` say how many
    documents hold which term; ``docs`` and ``times`` are their postings, term by term.
    """
    known = {term.encode("utf-8", "surrogatepass"): i for i, term in enumerate(terms)}

    def shard(parts: list[tuple]) -> pa.RecordBatch:
        ids, absent, length = (np.concatenate([p[i] for p in parts]) for i in range(3))
        ahead = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        doc = np.concatenate([p[3] + n for p, n in zip(parts, ahead)])
        term, times = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
        order = np.lexsort((ids, absent))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_term = np.lexsort((place[doc], term))
        present, counts = np.unique(term, return_counts=True)
        packed = [ids[order].astype("<i8"), absent[order], length[order].astype("<i8")]
        packed += [place[doc][by_term].astype("<i4"), times[by_term].astype("<i4")]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(ids)], pa.int64()),
                pa.array([int(length.sum())], pa.int64()),
                *[pa.array([x.tobytes()], pa.binary()) for x in packed],
                pa.array([present.tolist()], pa.list_(pa.int32())),
                pa.array([counts.tolist()], pa.list_(pa.int64())),
            ],
            ["n_docs", "n_terms", "ids", "absent", "lengths", "docs", "times", "terms", "counts"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_docs, n_postings = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(start, BATCH_ROWS)
                length, doc, term, times = _postings(some.column("text").to_pylist(), known)
                ids = some.column("doc_id")
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                kept = length > 0
                place = np.cumsum(kept) - 1
                parts.append((ids[kept], absent[kept], length[kept], place[doc], term, times))
                n_docs, n_postings = n_docs + int(kept.sum()), n_postings + len(term)
                if n_docs + BATCH_ROWS > SHARD_DOCS or n_postings > SHARD_POSTINGS:
                    yield shard(parts)
                    parts, n_docs, n_postings = [], 0, 0
        if n_docs:
            yield shard(parts)

    schema = "n_docs long, n_terms long, ids binary, absent binary, lengths binary, docs binary, times binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    return staged(rows.mapInArrow(build, f"{schema}, terms array<int>, counts array<long>"), "postings")


class Postings:
    """Documents with scores, ascending, and the largest score of each block of documents."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, n_blocks: int):
        self.docs, self.scores = docs, scores
        self.bound = np.zeros(n_blocks, np.int64)
        if len(docs):
            block = docs // BLOCK_DOCS
            first = np.flatnonzero(np.diff(block, prepend=-1))
            self.bound[block[first]] = np.maximum.reduceat(scores, first)


class Shard:
    """One shard's index, scored for the statistics of all documents."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.absent = np.frombuffer(row["absent"], bool)
        docs, times = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["times"], "<i4").astype(np.int64)
        lengths = np.frombuffer(row["lengths"], "<i8")
        if int(lengths.max(initial=0)) * 90 * n_docs >= 1 << 63:  # beyond 64 bits on the way only
            lengths = lengths.astype(object)
        spread = 8 * (10 + (90 * lengths * n_docs) // n_terms).astype(np.int64)
        scores = 1000000000 * times // (1000 * times + spread[docs])
        self.n_blocks = -(-len(self.ids) // BLOCK_DOCS)
        self.docs = docs.astype(np.int64)
        self.weights = weights
        ends = np.cumsum(row["counts"]) if row["counts"] else np.empty(0, np.int64)
        self.range = {t: (int(e - c), int(e)) for t, c, e in zip(row["terms"], row["counts"], ends)}
        self.scores = scores
        self.long: dict[int, Postings] = {}

    def _list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.range[term]
        return self.docs[start:end], self.scores[start:end] * self.weights[term]

    def lists(self, terms: list[int]) -> list[Postings]:
        """The accumulators of the short lists as one list, and the long lists."""
        held = [t for t in terms if t in self.range and self.weights[t] > 0]
        most = len(self.ids) // SHORT_SHARE
        short = [t for t in held if self.range[t][1] - self.range[t][0] <= most]
        found = []
        for t in held:
            if self.range[t][1] - self.range[t][0] > most:
                if t not in self.long:
                    self.long[t] = Postings(*self._list(t), self.n_blocks)
                found.append(self.long[t])
        if short:
            docs, scores = (np.concatenate(x) for x in zip(*[self._list(t) for t in short]))
            order = np.argsort(docs, kind="stable")
            docs, first = np.unique(docs[order], return_index=True)
            found.append(Postings(docs, np.add.reduceat(scores[order], first), self.n_blocks))
        return found

    def search(self, terms: list[int], best: Best) -> None:
        lists = self.lists(terms)
        bounds = sum((p.bound for p in lists), np.zeros(self.n_blocks, np.int64))
        for start in range(0, self.n_blocks, WINDOW_BLOCKS):
            end = min(start + WINDOW_BLOCKS, self.n_blocks)
            possible = (bounds[start:end] >= best.least) & (bounds[start:end] > 0)
            if not possible.any():
                continue
            # From the list of the smallest bound on: those that together stay below cannot start a document.
            order = sorted(lists, key=lambda p: int(p.bound[start:end].max()))
            reach = np.cumsum([int(p.bound[start:end].max()) for p in order])
            optional = order[: int(np.searchsorted(reach, best.least))]
            first, last = start * BLOCK_DOCS, min(end * BLOCK_DOCS, len(self.ids))
            score = np.zeros(last - first, np.int64)
            for p in order[len(optional) :]:
                low, high = np.searchsorted(p.docs, [first, last])
                score[p.docs[low:high] - first] += p.scores[low:high]
            doc = np.flatnonzero(score)
            doc = doc[possible[doc // BLOCK_DOCS]]
            score, block, doc = score[doc], start + doc // BLOCK_DOCS, first + doc
            rest = sum((p.bound for p in optional), np.zeros(self.n_blocks, np.int64))
            for p in reversed(optional):
                open_ = score + rest[block] >= best.least
                doc, score, block = doc[open_], score[open_], block[open_]
                if not len(doc):
                    break
                rest = rest - p.bound
                at = np.minimum(np.searchsorted(p.docs, doc), len(p.docs) - 1)
                score = score + np.where(p.docs[at] == doc, p.scores[at], 0)
            open_ = score >= best.least
            best.add(score[open_], self.absent[doc[open_]], self.ids[doc[open_]])


class Best:
    """The k best of one query so far: by score, then by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1  # a score must be above 0
        self.rows = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        if not len(score):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, (score, absent, ids))]
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.rows = tuple(x[order] for x in rows)
        if len(order) == self.k:
            self.least = max(1, int(self.rows[0][-1]))


def term_weight(n_docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))


def _search_block(docs: DataFrame, wanted: list, k: int) -> DataFrame:
    """The k best of each task for queries whose terms are known."""
    numbers: dict[str, int] = {}
    queries: dict[int | None, list[int]] = {}
    for row in wanted:
        queries.setdefault(row["item_id"], []).append(numbers.setdefault(row["term"], len(numbers)))
    shards = index(docs, list(numbers))
    n_docs, n_terms = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    holders = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms")
    weights = np.zeros(len(numbers), np.int64)
    # One row per term of the queries in this pass.
    for term, count in holders.agg(F.sum("t.counts")).collect():
        weights[term] = term_weight(n_docs, count)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms)
                for item, terms in queries.items():
                    shard.search(terms, best[item])
        for item, found in best.items():
            score, absent, ids = found.rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=absent), pa.array(score)],
                ["item_id", "doc_id", "score"],
            )

    return shards.mapInArrow(find, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, query_terms: int = QUERY_TERMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of each item.

    Every row of ``docs`` is a document, repeated rows too; null and empty texts have no terms. Equal
    scores go to the smaller ``doc_id``, null ids last. Rows of ``items`` with equal ids (null among
    them) are one item with all their terms. Items without a term that occurs, and empty tables, give
    no rows. Other columns are not looked at. Queries of more than about ``query_terms`` terms
    are taken in several passes over the documents; a single item is never split.
    """
    terms = staged(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")), "queries")
    passes = max(1, -(-terms.count() // query_terms))
    found = None
    for number in range(passes):
        own = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number
        part = _search_block(docs, terms.where(own).collect(), k)
        found = part if found is None else found.unionAll(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
t AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM t, s GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
x AS (
  SELECT item_id, r, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN f USING (term), s GROUP BY item_id, r, doc_id),
y AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
