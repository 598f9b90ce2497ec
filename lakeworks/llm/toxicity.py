"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The vectors hold all words of a text, weighted by their document frequencies over all documents.
The training rows' vectors lie in an inverted index: examples are numbered in blocks, like ones
together. Queries are looked up some at a time. The postings of their rarer words are summed; of
the most frequent words, whose postings are long, every block knows the largest weights, which
bound what these words can add. Only in blocks that can still win, by that bound, are their exact
sums made, as one product of matrices; what comes within rounding of the k-th best is summed again
in one order for all: the neighbours are exact. Words that no example has lengthen a text's vector
only: they leave the order of its neighbours as it is, and their frequencies and weights are
brought together by joins. The neighbours vote, weighted by nearness; a monotone map, learned on
the training rows with each one left out, turns votes into probabilities. The neighbours' ids are
the evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.llm.common import id_and_text, list_array, over_batches, staged
from lakeworks.llm.quality import training_rows
from lakeworks.llm.spans import WORD, Words, blocks

#: Labelled rows the examples come from, at most.
TRAINING_ROWS = 16384
NEIGHBOURS = 16
BLOCK_EXAMPLES = 64
#: Words whose weights in all examples lie in a matrix, at most; each is in one of so many examples at least.
FREQUENT = 256
ONE_OF = 64
#: Of the most frequent words so many order the examples.
LEADING_WORDS = 32
#: Queries that are looked up together.
AT_ONCE = 64
#: Similarities are rounded to so many digits, so that equal ones tie.
DIGITS = 12
SLACK = 1e-11
#: Weight of the base rate among the votes, and the distance at which a vote counts half.
PRIOR_VOTES = 0.5
HALF_DISTANCE = 0.1


def lowered(texts: list[str]) -> list[str]:
    return [text.lower() for text in texts]


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``low`` and are ``size`` long, one after another."""
    places = np.repeat(low - (np.cumsum(size) - size), size)
    places += np.arange(len(places))
    return places


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, occurrences) of the distinct words of each text, by text."""
    words = Words(lowered(texts), WORD)
    text, word = np.repeat(np.arange(len(texts)), words.count), words.hash
    order = np.lexsort((word, text))
    text, word = text[order], word[order]
    new = np.ones(len(word), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    return text[first], word[first], np.diff(np.append(first, len(word)))


def _places(vocabulary: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in the sorted vocabulary, and whether it is there."""
    if not len(vocabulary):
        return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
    place = np.minimum(np.searchsorted(vocabulary, word), len(vocabulary) - 1)
    return place, vocabulary[place] == word


class Examples:
    """The block-max inverted index over the examples that have words; the vocabulary are their words."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, documents: int = 0):
        order = np.argsort(vocabulary)
        self.vocabulary, self.idf, self.documents = vocabulary[order], idf[order], documents
        self.broadcast = None
        self.votes_at, self.chance_at = np.array([0.0]), np.array([0.0])
        self.ids, self.labels, self.rate, self.rate_without = np.empty(0, np.int64), np.empty(0), 0.0, 0.0

    def _words_of(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text with words: its number; their hashes, occurrences, places in the vocabulary, and which are in it."""
        for some in blocks(texts):
            text, word, times = _distinct(texts[some])
            place, known = _places(self.vocabulary, word)
            bounds = np.searchsorted(text, np.arange(some.stop - some.start + 1))
            for i in np.unique(text):
                own = slice(bounds[i], bounds[i + 1])
                yield some.start + i, word[own], times[own], place[own], known[own]

    def vectors(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, list]:
        """Of each text: numbers and weights (1 + ln tf) * idf of the vocabulary's words, brought to
        unit length; the squared length before; hashes and squared (1 + ln tf) of all other words."""
        result = [(np.empty(0, np.int64), np.empty(0))] * len(texts)
        square, others = np.zeros(len(texts)), [(np.empty(0, np.uint64), np.empty(0))] * len(texts)
        for i, word, times, place, known in self._words_of(texts):
            tf = 1 + np.log(times)
            others[i] = (word[~known], tf[~known] ** 2)
            if known.any():
                weight = tf[known] * self.idf[place[known]]
                square[i] = (weight**2).sum()
                result[i] = (place[known], weight / np.sqrt(square[i]))
        return result, square, others

    def counted(self, texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """The same vectors in less space: numbers and occurrences of the vocabulary's words, and the lengths."""
        result, length = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(texts), np.ones(len(texts))
        for i, _, times, place, known in self._words_of(texts):
            if known.any():
                result[i] = (place[known], times[known])
                length[i] = np.sqrt((((1 + np.log(times[known])) * self.idf[place[known]]) ** 2).sum())
        return result, length

    def indexed(self, numbers: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vectors of the examples with these numbers (of all, by number), taken from the postings."""
        numbers = np.arange(len(self.number)) if numbers is None else numbers
        order = np.full(len(self.number), -1, np.int32)
        order[self._place()[numbers]] = np.arange(len(numbers))
        at = np.flatnonzero(order[self.example] >= 0)
        whose, word = order[self.example[at]], np.searchsorted(self.words, at, "right") - 1
        weight = self._weights(at, word)
        order = np.argsort(whose, kind="stable")
        bounds = np.searchsorted(whose[order], np.arange(len(numbers) + 1))
        return [(word[own], weight[own]) for own in (order[a:b] for a, b in pairwise(bounds))]

    def _place(self) -> np.ndarray:
        """Where the example with each number lies."""
        place = np.empty(len(self.number), np.int64)
        place[self.number] = np.arange(len(self.number))
        return place

    def _weights(self, at: np.ndarray | slice, word: np.ndarray) -> np.ndarray:
        """The weights of the postings at these places, which belong to these words."""
        if self.length is None:
            return self.value[at]
        return (1 + np.log(self.value[at].astype(float))) * self.idf[word] / self.length[self.example[at]]

    def index(self, ids: np.ndarray, labels: np.ndarray, vectors: Iterable, lengths: np.ndarray | None = None) -> None:
        """Index the examples that have words; they are known by their number among these.

        ``vectors`` hold weights or, where ``lengths`` are given, occurrences, which are kept in as
        few bytes as they need. They are let go as soon as they are taken over: an iterator need
        not keep them either.
        """
        vectors = list(vectors)
        self.rate = (labels.sum() + 0.5) / (len(labels) + 1)
        filled = np.array([len(v[0]) > 0 for v in vectors], bool)
        without = labels[~filled]
        self.rate_without = (without.sum() + self.rate) / (len(without) + 1)
        vectors = [v for v in vectors if len(v[0])]
        self.ids, self.labels = ids[filled], labels[filled].astype(float)
        # Like examples get neighbouring places, equal ones in the given order.
        self.number = self._like_together(vectors, lengths is not None)
        self.length = None if lengths is None else lengths[filled][self.number]
        vectors = [vectors[i] for i in self.number]
        count = np.array([len(v[0]) for v in vectors], np.int64)
        word = np.concatenate([v[0] for v in vectors]).astype(np.int32, copy=False) if vectors else np.empty(0, np.int32)
        value = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        self.n_blocks = -(-len(vectors) // BLOCK_EXAMPLES)
        del vectors
        order = np.argsort(word, kind="stable")
        word = word[order]
        self.words = np.searchsorted(word, np.arange(len(self.vocabulary) + 1)).astype(np.int32)
        del word
        self.value = value[order]
        del value
        self.example = np.repeat(np.arange(len(count), dtype=np.min_scalar_type(len(count))), count)[order]
        self.weight = None

    def _like_together(self, vectors: list, counted: bool) -> np.ndarray:
        """The examples in an order by their heaviest two of the most frequent words, which tell their
        language, and by how much these words weigh, which tells their length."""
        frequency = np.zeros(len(self.vocabulary), np.int64)
        for word, _ in vectors:
            frequency[word] += 1
        leading = np.zeros(len(frequency), bool)
        leading[np.argsort(-frequency, kind="stable")[:LEADING_WORDS]] = True

        def key(vector: tuple[np.ndarray, np.ndarray]) -> tuple:
            word, value = vector
            weight = (1 + np.log(value.astype(float))) * self.idf[word] if counted else value
            total = np.sqrt((weight**2).sum())
            word, weight = word[leading[word]], weight[leading[word]]
            return (*word[np.lexsort((word, -weight))[:2]].tolist(), -1, -1)[:2], -weight.sum() / total

        keys = [key(v) for v in vectors]
        return np.array(sorted(range(len(vectors)), key=keys.__getitem__), np.int64)

    def _prepare(self) -> None:
        """What only tasks need: all weights, and those of the frequent words by example and by block."""
        size, frequency = self.n_blocks * BLOCK_EXAMPLES, np.diff(self.words)
        self.weight = np.empty(len(self.value))
        for some in np.array_split(np.arange(len(frequency)), max(1, len(self.value) >> 18)):
            if len(some):  # not all at once: the steps between take room
                own = slice(self.words[some[0]], self.words[some[-1] + 1])
                self.weight[own] = self._weights(own, np.repeat(some, frequency[some]))
        often = np.argsort(-frequency, kind="stable")[:FREQUENT]
        often = often[frequency[often] * ONE_OF > size]
        self.row = np.full(len(frequency), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.often = np.zeros((len(often), size))
        for row, word in zip(self.often, often):
            own = slice(self.words[word], self.words[word + 1])
            row[self.example[own]] = self.weight[own]
        self.most = self.often.reshape(len(often), self.n_blocks, BLOCK_EXAMPLES).max(2)

    def __getstate__(self) -> dict:
        """What cannot be computed again; tasks get the calibration on its own."""
        return {k: v for k, v in vars(self).items() if k not in ("weight", "row", "often", "most", "broadcast")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.weight, self.broadcast = None, None

    def shared(self, spark: SparkSession):
        """The model in tasks, sent once."""
        if self.broadcast is None:
            self.broadcast = spark.sparkContext.broadcast(self)
        return self.broadcast

    def nearest(self, word: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the ``k`` nearest, nearest first, ties to the smaller number."""
        found, score = self.neighbours([(word, weight)], k + 1)[0]
        return _without(found, score, but, k)

    def neighbours(self, vectors: list, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each vector, as ``nearest``; equal ones are looked up once."""
        keys = [(word.tobytes(), np.round(weight, DIGITS).tobytes()) for word, weight in vectors]
        known = dict.fromkeys(keys, (np.empty(0, np.int64), np.empty(0)))
        if len(self.ids):
            if self.weight is None:
                self._prepare()
            distinct = {key: vector for key, vector in zip(keys, vectors) if len(vector[0])}
            # Queries that are heaviest in the same frequent word want the same blocks.
            order = sorted(distinct, key=lambda key: self._leading(*distinct[key]))
            for start in range(0, len(order), AT_ONCE):
                some = order[start : start + AT_ONCE]
                known.update(zip(some, self._look_up([distinct[key] for key in some], k)))
        return [known[key] for key in keys]

    def _leading(self, word: np.ndarray, weight: np.ndarray) -> int:
        here = self.row[word] >= 0
        return int(word[here][weight[here].argmax()]) if here.any() else -1

    def _look_up(self, vectors: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        size = self.n_blocks * BLOCK_EXAMPLES
        often, sums = np.zeros((len(vectors), len(self.often))), np.zeros((len(vectors), size))
        for own, total, (word, weight) in zip(often, sums, vectors):
            row = self.row[word]
            own[row[row >= 0]] = weight[row >= 0]
            word, weight = word[row < 0], weight[row < 0]
            count = self.words[word + 1] - self.words[word]
            at = _ranges(self.words[word], count)
            np.add.at(total, self.example.take(at).astype(np.intp), np.repeat(weight, count) * self.weight.take(at))
        # In k blocks there is an example each that reaches the k-th largest of the blocks' best.
        in_blocks = sums.reshape(len(vectors), self.n_blocks, BLOCK_EXAMPLES)
        best = in_blocks.max(2)
        least = np.partition(best, -k, axis=1)[:, -k] if self.n_blocks >= k else np.zeros(len(vectors))
        some = np.flatnonzero((best + often @ self.most >= least[:, None] - SLACK).any(0))
        places = (some[:, None] * BLOCK_EXAMPLES + np.arange(BLOCK_EXAMPLES)).ravel()
        of_blocks = self.often.reshape(len(self.often), self.n_blocks, BLOCK_EXAMPLES)
        if len(some) < self.n_blocks:
            in_blocks, of_blocks = in_blocks.take(some, 1), of_blocks.take(some, 1)
        whole = often @ of_blocks.reshape(len(self.often), len(places))
        whole += in_blocks.reshape(len(vectors), len(places))
        result = []
        for own, total, near in zip(often, sums, whole):
            best = near.reshape(-1, BLOCK_EXAMPLES).max(1)
            least = np.partition(best, -k)[-k] if len(best) >= k else 0.0
            here = np.flatnonzero((near >= least - SLACK) & (near > 0))
            if len(here) > k:
                here = here[near[here] >= np.partition(near[here], -k)[-k] - SLACK]
            here, rows = places[here], np.flatnonzero(own)
            # Summed example by example: equal ones get equal sums, wherever they lie.
            exact = (np.ascontiguousarray(self.often[np.ix_(rows, here)].T) * own[rows]).sum(1) if len(rows) else 0.0
            score, found = np.round(total[here] + exact, DIGITS), self.number[here]
            first = np.lexsort((found, -score))[:k]
            first = first[score[first] > 0]
            result.append((found[first], score[first]))
        return result

    def vote(self, found: np.ndarray, score: np.ndarray) -> float:
        """The share of label 1 among the neighbours, weighted by nearness."""
        nearness = HALF_DISTANCE / (HALF_DISTANCE + np.maximum(0, 1 - score))
        return float((nearness @ self.labels[found] + PRIOR_VOTES * self.rate) / (nearness.sum() + PRIOR_VOTES))

    def calibrate(self, votes: np.ndarray) -> None:
        """The best rising map from the examples' left-out votes to their labels, by pooling."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # labels, rows, votes
        for vote, label in zip(votes[order], self.labels[order]):
            pools.append([label, 1.0, vote])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        if pools:
            self.votes_at = np.array([v / n for _, n, v in pools])
            # Half a row of the base rate keeps a pool from being certain.
            self.chance_at = np.array([(y + 0.5 * self.rate) / (n + 0.5) for y, n, _ in pools])

    def score(self, found: np.ndarray, score: np.ndarray) -> float:
        if not len(found):
            return float(self.rate_without)
        vote = self.vote(found, score)
        # Within a pool a little of the vote itself keeps the order of near cases.
        return float(0.98 * np.interp(vote, self.votes_at, self.chance_at) + 0.02 * vote)


def _without(found: np.ndarray, score: np.ndarray, but: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of the neighbours, one number left out."""
    return found[found != but][:k], score[found != but][:k]


def _word_counts(rows: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """(word, n): the rows each word is in; with a sorted vocabulary, only its words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        words = [_distinct(texts[some])[1] for some in blocks(texts)]
        word, n = np.unique(np.concatenate(words) if words else np.empty(0, np.uint64), return_counts=True)
        if vocabulary is not None:
            known = _places(vocabulary, word)[1]
            word, n = word[known], n[known]
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return over_batches(rows, work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Examples:
    """Vocabulary, document frequencies over all documents, examples and calibration.

    ``usable`` (over ``doc_id``) tells which labelled rows may be learned from.
    """
    chosen = staged(training_rows(docs, labels, "toxic", usable, TRAINING_ROWS), "toxic-examples")
    # The distinct words of at most TRAINING_ROWS texts; one row each, counted over every document.
    vocabulary = _word_counts(chosen.select("text")).select("word").toArrow().column("word")
    vocabulary = np.sort(vocabulary.to_numpy().view(np.uint64))
    frequency = np.zeros(len(vocabulary))
    if len(vocabulary):
        seen = _word_counts(docs.select(F.coalesce("text", F.lit("")).alias("text")), vocabulary).toArrow()
        frequency[_places(vocabulary, seen.column("word").to_numpy().view(np.uint64))[0]] = seen.column("n").to_numpy()
    total = docs.count()
    model = Examples(vocabulary, 1 + np.log((1 + total) / (1 + frequency)), total)
    # At most TRAINING_ROWS vectors, as bytes.
    rows = over_batches(
        chosen, lambda batch: _vectors(batch, model), "doc_id long, label int, length double, word binary, times binary"
    ).toArrow()
    vectors = list(zip(_split(rows.column("word")), _split(rows.column("times"))))
    vectors = [(np.frombuffer(w, np.int32), _numbers(t, w.size // 4)) for w, t in vectors]
    ids, label, length = (rows.column(c).to_numpy() for c in ("doc_id", "label", "length"))
    order = _by_id(ids, label, vectors)
    vectors = [vectors[i] for i in reversed(order)]
    del rows
    model.index(ids[order], label[order].astype(float), (vectors.pop() for _ in order), length[order])
    # The driver keeps the index alone: what the collected rows took goes back.
    pa.default_memory_pool().release_unused()
    model.calibrate(_left_out(docs.sparkSession, model))
    return model


def _by_id(ids: np.ndarray, labels: np.ndarray, vectors: list) -> list[int]:
    """The order by id, label and vector; vectors are looked at for equal ids and labels only."""
    order: list[int] = []
    for _, same in groupby(np.lexsort((labels, ids)).tolist(), lambda i: (ids[i], labels[i])):
        some = list(same)
        if len(some) > 1:
            some.sort(key=lambda i: (vectors[i][0].tobytes(), vectors[i][1].tobytes()))
        order += some
    return order


def _split(binary: pa.ChunkedArray) -> list[pa.Buffer]:
    return [value.as_buffer() for chunk in binary.chunks for value in chunk]


def _numbers(data: pa.Buffer, count: int) -> np.ndarray:
    """Unsigned integers of whatever width they were stored in."""
    return np.frombuffer(data, f"u{data.size // count if count else 1}")


def _vectors(batch: pa.RecordBatch, model: Examples) -> pa.RecordBatch:
    vectors, length = model.counted(batch.column("text").to_pylist())
    words = [word.astype(np.int32).tobytes() for word, _ in vectors]
    times = [times.astype(np.min_scalar_type(times.max(initial=0))).tobytes() for _, times in vectors]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("label"), pa.array(length), pa.array(words, pa.binary()), pa.array(times, pa.binary())],
        ["doc_id", "label", "length", "word", "times"],
    )


def _left_out(spark, model: Examples) -> np.ndarray:
    """The vote of each example without itself, computed in tasks."""
    if not len(model.ids):
        return np.empty(0)
    shared = model.shared(spark)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, numbers = shared.value, batch.column("id").to_numpy()
        found = known.neighbours(known.indexed(numbers), NEIGHBOURS + 1)
        votes = [known.vote(*_without(*f, i, NEIGHBOURS)) for f, i in zip(found, numbers)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(votes, pa.float64())], ["id", "vote"])

    found = over_batches(spark.range(len(model.ids)), work, "id long, vote double").collect()
    return np.array([r["vote"] for r in sorted(found, key=lambda r: r["id"])])


def scored(docs: DataFrame, model: Examples) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``evidence`` (ids of the nearest examples) of each row.

    One pass over whole texts finds the neighbours; the words that no example has are counted
    over all documents and joined to their rows. A text that shares no word with an example, and
    so a null or empty one, gets the rate of the empty training rows and no evidence. Ties
    between examples go to the smaller id; repeated rows get equal scores. Without usable
    labels every score is one half.
    """
    shared = model.shared(docs.sparkSession)
    votes_at, chance_at = model.votes_at, model.chance_at

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        vectors, square, others = known.vectors(batch.column("text").to_pylist())
        found = known.neighbours(vectors)
        lengths = np.array([len(f[0]) for f in found], np.int64)
        beyond = np.array([len(o[0]) for o in others], np.int64)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(square),
                list_array(join([f[0] for f in found], np.int64), lengths),
                list_array(join([f[1] for f in found], float), lengths),
                list_array(join([o[0].view(np.int64) for o in others], np.int64), beyond),
                list_array(join([o[1] for o in others], float), beyond),
            ],
            ["doc_id", "square", "found", "near", "word", "times"],
        )

    # Written once: the row numbers on both sides of the join are the same.
    schema = "doc_id long, square double, found array<long>, near array<double>, word array<long>, times array<double>"
    rows = staged(over_batches(id_and_text(docs), look, schema).withColumn("row", F.monotonically_increasing_id()), "toxic-found")
    other = rows.select("row", F.explode(F.arrays_zip("word", "times")).alias("w")).select("row", "w.word", "w.times")
    # A word outside the vocabulary is in as many documents as it has rows here.
    seen = other.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    idf = 1 + F.log(F.lit(1.0 + model.documents) / (1 + F.col("n")))
    # Added in sorted order, so that equal texts have equal sums.
    beyond = (
        other.join(seen, "word")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.col("times") * idf * idf)).alias("squares"))
        .select("row", F.aggregate("squares", F.lit(0.0), lambda total, x: total + x).alias("beyond"))
    )

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        known.votes_at, known.chance_at = votes_at, chance_at
        square, beyond = batch.column("square").to_numpy(), batch.column("beyond").to_numpy()
        share = np.sqrt(square / np.maximum(square + beyond, 1e-300))
        found = [np.array(f, np.int64) for f in batch.column("found").to_pylist()]
        near = [np.round(np.array(n, float) * s, DIGITS) for n, s in zip(batch.column("near").to_pylist(), share)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([known.score(*f) for f in zip(found, near)], pa.float64()),
                pa.array([known.ids[f].tolist() for f in found], pa.list_(pa.int64())),
            ],
            ["doc_id", "score", "evidence"],
        )

    whole = rows.join(beyond, "row", "left").select("doc_id", "square", "found", "near", F.coalesce("beyond", F.lit(0.0)).alias("beyond"))
    return over_batches(whole, judge, "doc_id long, score double, evidence array<long>")
