from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeworks.llm import language
from lakeworks.llm.queries import op12_language

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = {"en": "the of and with from house green water", "de": "der die und mit von haus grün wasser"}
WORDS |= {"fr": "les des avec maison verte eau être où", "el": "και του σπίτι πράσινο νερό από"}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(WORDS)
    return [
        (i, " ".join(rng.choice(WORDS[langs[i % 4]].split(), size=int(rng.integers(3, 30)))), langs[i % 4], "s")
        for i in range(n)
    ]


def grams(text):
    """N-grams of the normalised text as a dictionary, byte by byte."""
    data, out = bytearray(b" "), Counter()
    for byte in text.lower().encode() + b" ":
        byte = byte if byte >= 0x80 or 0x61 <= byte <= 0x7A else 0x20
        if not (byte == 0x20 and data[-1] == 0x20):
            data.append(byte)
    for n in range(1, language.GRAMS + 1):
        for i in range(len(data) - n + 1):
            gram = bytes(data[i : i + n])
            if gram.strip():
                code = 0
                for byte in gram:
                    code = code * 257 + byte + 1
                out[code * 0x9E3779B97F4A7C15 % 2**64 >> 52] += 1
    return out


def test_counts_equal_those_of_single_texts(monkeypatch):
    some = ["The 3 Houses, ÄÖ!", "", "   ", "x", "a b\n\nc", "…", "grün" * 50, "1 2 3"]
    made = language.gram_counts(some)
    for row, text in zip(made, some):
        assert {i: int(n) for i, n in enumerate(row) if n} == dict(grams(text))
    monkeypatch.setattr(language, "CHUNK_BYTES", 7)
    assert (language.gram_counts(some) == made).all()
    assert language.gram_counts([]).shape == (0, language.BUCKETS)


def test_a_long_text_counts_as_its_parts():
    part = "the house of green water "
    one, many = language.gram_counts([part * 2]), language.gram_counts([part * 200000])
    assert many.sum() > 4 * 200000 * 20
    assert ((many > 0) == (one > 0)).all()


def test_predictions_equal_brute_force(spark):
    rows = texts(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs, F.lit(True))
    assert set(model.languages) == set(WORDS) and max(Counter(model.languages).values()) > 1
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    n, holders = len(rows), Counter(b for _, t, *_ in rows for b in grams(t))
    idf = {b: math.log((1 + n) / (1 + c)) + 1 for b, c in holders.items()}
    for row in language.predicted(docs, model).collect():
        counts = grams(rows[row["doc_id"]][1])
        v = {b: math.log1p(c) * idf[b] for b, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        similar = [sum(x / norm * m[b] for b, x in v.items()) for m in model.centroids]
        best = int(np.round(similar, 9).argmax())
        assert row["score"] == pytest.approx(similar[best], abs=1e-6)
        assert row["lang_pred"] == model.languages[best] == rows[row["doc_id"]][2]


def test_centroids_find_the_kinds_of_text_of_a_language():
    rng = np.random.default_rng(0)
    kinds = np.eye(30)[[0, 10, 20]]
    v = np.abs(kinds[rng.integers(3, size=300)] + rng.normal(size=(300, 30)) * 0.02)
    v /= np.linalg.norm(v, axis=1)[:, None]
    middle, limit = language.clustered(v, 3, 10)
    assert sorted(middle.argmax(1).tolist()) == [0, 10, 20]
    assert (limit < 0.1).all()
    assert len(language.clustered(np.tile(v[:1], (9, 1)), 4, 10)[0]) == 1


def test_unreadable_odd_repeated_and_foreign_texts(spark):
    model = language.train(spark.createDataFrame(texts(400), SCHEMA), F.lit(True))
    odd = [(1, None), (2, ""), (3, "123 ... 45"), (4, "house"), (4, "house"), (None, "wasser und haus")]
    odd += [(5, "これは日本語の文章です"), (6, "the " * 300000), (7, "²½"), (8, "The HOUSE! of... the WATER?")]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in odd], SCHEMA)
    made = [tuple(r) for r in language.predicted(frame, model).collect()]
    assert Counter(r[0] for r in made) == Counter(i for i, _ in odd)
    pred = {r[0]: r[1] for r in made}
    assert [pred[i] for i in (1, 2, 3, 7)] == ["und"] * 4 and pred[None] == "de"
    assert pred[4] == pred[6] == pred[8] == "en" and pred[5] in WORDS
    assert {r[0] for r in made if r[3]} >= {1, 2, 3, 5, 7} and not {r[0] for r in made if r[3]} & {8}
    assert all(0 <= r[2] <= 1 for r in made)


def test_null_languages_and_nothing_learned(spark):
    rows = [(i, t, lang if i % 3 else None, s) for i, t, lang, s in texts(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert set(language.train(docs, F.lit(True)).languages) == set(WORDS)
    empty = language.train(docs.where("lang IS NULL"), F.lit(True))
    made = language.predicted(docs, empty).select("lang_pred", "score", "rejected").distinct().collect()
    assert [tuple(r) for r in made] == [("und", 0.0, True)]
    assert language.predicted(docs.limit(0), empty).count() == 0


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = texts(300) + [(1, "the the the copy", "en", "s")] * 500
    docs = spark.createDataFrame(rows, SCHEMA)
    one = language.train(docs, F.lit(True), rows=1)
    assert all(n <= 1 for n in Counter(one.languages).values())
    two = language.train(docs, F.lit(True), languages=2)
    assert len(set(two.languages)) == 2 and "en" in two.languages


def test_only_learning_rows_and_text_decide(spark):
    rows = texts(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs, F.col("doc_id") < 120)
    relabelled = spark.createDataFrame([(i, t if i < 120 else "zzz", lang if i < 120 else "xx", s) for i, t, lang, s in rows], SCHEMA)
    again = language.train(relabelled, F.col("doc_id") < 120)
    assert model.languages == again.languages and np.allclose(model.centroids, again.centroids)
    named = docs.selectExpr("*", "1 AS h", "2 AS v", "3 AS i", "4 AS readable", "5 AS rejected", "6 AS n")
    made, plain = (language.predicted(d, language.train(d, F.col("doc_id") < 120)) for d in (named, docs))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, plain.collect()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    made = op12_language(spark, SF).join(docs, "doc_id").where("held_out")
    right = made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right[0] > 0.98 and right[1] > 200
