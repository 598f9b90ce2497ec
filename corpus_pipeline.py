"""From raw documents to tokens: five stages, each written as Parquet and read by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows the one before kept; all but the
last return the columns of ``documents``.

* ``quality`` drops documents the quality ranking scores below its decision value.
* ``near_duplicates`` keeps one document of each near-duplicate class.
* ``personal_data`` replaces addresses, numbers and what their contexts reveal by their kind.
* ``mixture`` takes the sources at their target weights: a row for each pass that takes a part of
  a document, with that part as its text.
* ``tokens`` encodes each row and decodes it again, and gives counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeworks.llm import bpe, mixing, neardup, pii, quality
from lakeworks.llm.common import remainder, table
from lakeworks.llm.queries import vocabulary_path
from lakeworks.sources.scratch import new_folder


def rank_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.kept_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_documents(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs, vocabulary_path()))


STAGES = [
    ("quality", rank_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode),
]

# Learning, sampling and encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
