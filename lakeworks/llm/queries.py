"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.llm import (
    bpe,
    centroids,
    hnsw,
    language,
    lexical,
    licenses,
    mixing,
    mtree,
    neardup,
    pii,
    quality,
    token_files,
    toxicity,
)
from lakeworks.llm.common import remainder, table
from lakeworks.sources.scratch import new_folder


def vocabulary_path() -> str:
    """The word vocabulary that the environment provides."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, remainder("doc_id", 5) != 0)
    return toxicity.scored(documents, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "evidence",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, remainder("doc_id", 4) != 2)
    return quality.scored(documents, model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.DECISION).cast("int").alias("predicted"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).taken().select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files, and takes everything it returns from them."""
    documents = table(spark, sf_dir, "documents")
    size = documents.select(F.sum(F.octet_length("text"))).head()[0] or 0
    path = new_folder(spark, "tokens")
    token_files.write_tokens(documents, path, vocabulary_path(), size)
    rows = token_files.checksums(token_files.read_tokens(spark, path))
    return rows.join(token_files.offsets(spark, path), ["part", "position"]).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path()))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents, remainder("doc_id", 4) != 2)
    held_out = (remainder("doc_id", 4) == 2).alias("held_out")
    return language.predicted(documents, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_neighbours": op4_neighbours,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_mixing": op7_mixing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_lexical": op11_lexical,
    "op12_language": op12_language,
    "op13_centroids": op13_centroids,
}

SQL = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_lexical": lexical.SQL,
    "op13_centroids": centroids.SQL,
}
