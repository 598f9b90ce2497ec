"""The corpus pipeline, stage by stage, each on its own input."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lakeworks.llm import neardup, quality
from lakeworks.llm.common import remainder, table
from lakeworks.llm.queries import vocabulary_path

SF_DIR = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Name -> (input, output) of every stage, as written and read again."""
    found, docs = {}, table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF_DIR).write.parquet(path)
        found[name] = docs, spark.read.parquet(path)
        docs = found[name][1]
    return found


def test_order_and_columns(spark, steps):
    assert list(steps) == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
    columns = table(spark, SF_DIR, "documents").columns
    assert all(sorted(steps[n][1].columns) == sorted(columns) for n in list(steps)[:-1])


def test_quality_drops_what_it_scores_low(spark, steps):
    docs, kept = steps["quality"]
    model = quality.train(docs, table(spark, SF_DIR, "labels"), remainder("doc_id", 4) != 2)
    good = quality.scored(docs, model).where(F.col("score") >= quality.DECISION)
    ids = sorted(r.doc_id for r in good.collect())
    assert sorted(r.doc_id for r in kept.collect()) == ids
    assert 0 < len(ids) < docs.count()


def test_one_of_each_class_stays(steps):
    docs, kept = steps["near_duplicates"]
    class_of = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(class_of[i] for i in ids) == Counter(set(class_of.values()))


def test_no_address_is_left_and_no_document_lost(steps):
    docs, clean = steps["personal_data"]
    assert any(EMAIL.search(r.text or "") for r in docs.collect())
    assert not any(EMAIL.search(r.text or "") for r in clean.collect())
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect())


def test_no_document_is_taken_more_than_thrice(steps):
    docs, mixed = steps["mixture"]
    words = lambda rows: Counter({i: n for i, n in rows})
    size = words((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert taken and all(taken[i] <= 3 * size[i] for i in taken)


def test_tokens_are_the_library_s(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    docs, tokens = steps["tokens"]
    expected = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), text)]
        expected[(r.doc_id, len(ids), *digests)] += 1
    found = tokens.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(tuple(r) for r in found) == expected
