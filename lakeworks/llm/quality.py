"""Quality scores by Bradley-Terry pairwise ranking.

Every text has a few dozen features of its characters, words and lines. Each pair of a labelled
good and a labelled bad document says that the first beats the second; the weights maximise
the likelihood of these outcomes, a logistic loss on the difference of the features. The
utility below which documents are rejected is a quantile of the utilities of the training
rows, and the score is laid out so that this quantile falls on the wanted decision value.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.common import id_and_text, over_batches, smallest_by_hash, staged

#: Labelled rows that the model is fitted on, at most; pairs for each bad row; fitting steps.
TRAINING_ROWS = 16384
PAIRS_PER_ROW = 32
STEPS = 400
RIDGE = 1e-3
#: The score of a document at the quantile: at least this is kept.
DECISION = 0.7

_SINGLE = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\n\t "]
_WORD = re.compile(r"\w+")


def features(texts: list[str]) -> np.ndarray:
    """One row per text: shares of characters, word statistics and repetition; zeros if empty."""
    rows = np.zeros((len(texts), len(_SINGLE) + 11))
    for row, text in zip(rows, texts):
        if not text:
            continue
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        count = np.bincount(data, minlength=256) / len(data)
        row[: len(_SINGLE)] = count[_SINGLE]
        lines = [line for line in text.split("\n") if line]
        words = text.split()
        letters = max(1e-9, count[65:91].sum() + count[97:123].sum())
        row[len(_SINGLE) :] = [
            count[65:91].sum() / letters,
            count[97:123].sum(),
            count[48:58].sum(),
            count[128:].sum(),
            np.log1p(len(words)) / 10,
            len(set(words)) / max(1, len(words)),
            len(set(lines)) / max(1, len(lines)),
            min(1.0, len(words) / max(1, len(lines)) / 100),
            min(1.0, len(text) / max(1, len(words)) / 20),
            sum(w.isupper() for w in words) / max(1, len(words)),
            sum(1 for w in words if not w[-1].isalnum()) / max(1, len(words)),
        ]
    return np.sqrt(np.clip(rows, 0, None))


class Ranking:
    """Weights over standardised features, and how a utility becomes a score."""

    def __init__(self, mean: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.weights, self.threshold = mean, weights, threshold

    def utility(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        shift = np.log(DECISION / (1 - DECISION))
        return 1 / (1 + np.exp(-np.clip(self.utility(rows) - self.threshold + shift, -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray) -> Ranking:
    """Learn from rows with label 1 (better) and 0; without both kinds every score is the same.

    The quantile is the one at which rejecting what lies below agrees with most labels, a bad
    row kept and a good row rejected counting the same.
    """
    mean, spread = rows.mean(0), rows.std(0) + 1e-6
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        threshold = 0.0 if len(good) else 1e-9
        return Ranking(mean, np.zeros(rows.shape[1]), threshold)
    chance = np.random.default_rng(0)
    loser = np.repeat(bad, PAIRS_PER_ROW)
    difference = (rows[chance.choice(good, len(loser))] - rows[loser]) / spread
    weights = np.zeros(rows.shape[1])
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        wins = 1 / (1 + np.exp(-np.clip(difference @ weights, -500, 500)))
        slope = -(difference * (1 - wins)[:, None]).mean(0) + RIDGE * weights
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    utility = (rows - mean) @ (weights / spread)
    order = np.argsort(utility, kind="stable")
    ranked = labels[order]
    # Rejecting the first i rows: the bad among them are right, the good ones wrong.
    agree = np.concatenate([[0], np.cumsum(np.where(ranked == 0, 1, -1))])
    values = np.concatenate([[utility[order[0]] - 1], utility[order], [utility[order[-1]] + 1]])
    cut = int(agree.argmax())
    return Ranking(mean, weights / spread, float((values[cut] + values[cut + 1]) / 2))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """Distinct texts with labels (0 or 1), at most ``rows``, of documents chosen by a hash of the id.

    The bounded sample of labels goes to the documents. Equal rows are grouped, and what is left of
    an id with many texts comes after one text of every id.
    """
    some = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("label"))
    some = smallest_by_hash(
        some.where(F.col("label").isin(0, 1)).withColumnRenamed("labelled", "doc_id").where(usable), rows
    )
    found = id_and_text(docs).join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id", "text", "label"])
    found = staged(found, "labelled-texts")
    place = F.xxhash64("text", "label")
    first = found.groupBy(F.col("doc_id").alias("id")).agg(F.min(place).alias("first"))
    found = found.join(F.broadcast(first), F.col("doc_id") == F.col("id"))
    order = [place != F.col("first"), F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text"), F.col("label")]
    return found.orderBy(*order).limit(rows).select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Ranking:
    """Fit on labelled rows for which ``usable`` (over ``doc_id``) holds."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = features(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(found.tolist(), pa.list_(pa.float64()))],
            ["doc_id", "label", "features"],
        )

    chosen = training_rows(docs, labels, "quality", usable, TRAINING_ROWS)
    # One row of numbers for each of at most TRAINING_ROWS documents.
    rows = over_batches(chosen, work, "doc_id long, label int, features array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["features"]))
    width = len(_SINGLE) + 11
    return fit(
        np.array([r["features"] for r in rows], float).reshape(-1, width),
        np.array([r["label"] for r in rows], int),
    )


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row: one pass, no shuffle.

    Null and empty texts have features of zero and the score that follows; repeated rows get
    equal scores; other columns are not looked at.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(features(batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return over_batches(id_and_text(docs), work, "doc_id long, score double")


def kept_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns, that reach the decision value."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array(model.score(features(texts)) >= DECISION))

    return over_batches(docs, work, docs.schema)
