from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from compare import differences, duckdb_over

from lakeworks.llm import lexical
from lakeworks.llm.queries import op11_lexical

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(counted), sum(c for *_, c in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for i, c, length in counted:
            m = 100 - 90 + (90 * length * n) // total
            score = 0
            for w in words:
                if w in c:
                    weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    score += weight * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def prose(rng, words):
    return " ".join(f"w{min(int(x), 3000)}" for x in rng.zipf(1.3, size=words))


def test_equals_brute_force_over_shards_long_and_short_lists(spark):
    rng = np.random.default_rng(1)
    docs = [(i, prose(rng, int(rng.integers(1, 120)))) for i in range(1500)]
    items = [(i, prose(rng, 12) + f" w{i * 37 % 900} nowhere") for i in range(30)]
    frame = spark.createDataFrame(docs, DOCS)
    wanted = spark.createDataFrame(items, ITEMS)
    assert found(lexical.ranked(frame.coalesce(1), wanted)) == brute(docs, items)
    assert found(lexical.ranked(frame.repartition(7), wanted, 3, query_terms=60)) == brute(docs, items, 3)


def test_ties_copies_nulls_and_odd_texts(spark):
    docs = [(9, "Alpha beta"), (3, "alpha BETA"), (3, "alpha beta"), (None, "alpha beta"), (1, "beta"), (2, None), (4, "")]
    docs += [(5, "!!! ..."), (6, "ÄÖ äö ÄÖ"), (7, "gamma" * 3000), (8, "x-1 x_1 x1"), (-5, "alpha beta")]
    docs += [(11, "alpha beta")] * 30
    items = [(1, "ALPHA alpha"), (1, "beta"), (2, None), (3, ""), (4, "nowhere"), (None, "ÄÖ"), (5, "x 1 x1"), (6, "äö")]
    made = lexical.ranked(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS))
    assert found(made) == brute(docs, items)
    first = [r for r in found(made) if r[0] == 1]
    assert [r[2] for r in sorted(first, key=lambda r: r[1])][:3] == [-5, 3, 3]


def test_empty_tables_and_clashing_columns(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert found(lexical.ranked(none, items)) == []
    docs = [(1, "a b"), (2, "a a"), (3, "c")]
    frame = spark.createDataFrame(docs, DOCS)
    assert found(lexical.ranked(frame, spark.createDataFrame([], ITEMS))) == []
    named = frame.selectExpr("*", "1 AS term", "2 AS item_id", "3 AS rank", "4 AS ids", "5 AS n_docs", "6 AS score")
    assert found(lexical.ranked(named, items.selectExpr("*", "7 AS term", "8 AS doc_id"))) == brute(docs, [(1, "a")])


def test_long_texts_are_cut_between_words():
    rng = np.random.default_rng(4)
    text = prose(rng, 60000) * 8
    assert "".join(lexical._pieces(text)) == text and len(list(lexical._pieces(text))) > 1
    known = {b"w1": 0, b"w2": 1, b"w77": 2}
    length, doc, term, times = lexical._postings(["w2", text, ""], known)
    count = Counter(terms(text))
    assert length.tolist() == [1, sum(count.values()), 0]
    assert list(zip(doc.tolist(), term.tolist(), times.tolist())) == [
        (0, 1, 1), *[(1, n, count[w.decode()]) for w, n in known.items() if count[w.decode()]]
    ]


def test_windows_that_cannot_matter_are_skipped():
    """With the best in the first blocks, later windows are not summed."""
    n = 40000
    docs = [np.arange(0, n), np.arange(0, n, 3)]
    times = [np.where(np.arange(n) < 50, 40, 1), np.ones(len(docs[1]), int)]
    row = {
        "ids": np.arange(n).astype("<i8").tobytes(),
        "absent": np.zeros(n, bool).tobytes(),
        "lengths": np.full(n, 10).astype("<i8").tobytes(),
        "docs": np.concatenate(docs).astype("<i4").tobytes(),
        "times": np.concatenate(times).astype("<i4").tobytes(),
        "terms": [0, 1],
        "counts": [n, len(docs[1])],
    }
    shard = lexical.Shard(row, np.array([5, 1]), n, 10 * n)
    added, best = [], lexical.Best(10)
    add = best.add
    best.add = lambda *x: (added.append(len(x[0])), add(*x))
    shard.search([0, 1], best)
    assert best.rows[2].tolist() == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    assert len(added) == 1


def test_lengths_beyond_64_bits_on_the_way():
    n_docs, row = 1 << 40, {
        "ids": np.array([1]).astype("<i8").tobytes(),
        "absent": np.zeros(1, bool).tobytes(),
        "lengths": np.array([1 << 30]).astype("<i8").tobytes(),
        "docs": np.zeros(1, "<i4").tobytes(),
        "times": np.array([7]).astype("<i4").tobytes(),
        "terms": [0],
        "counts": [1],
    }
    shard = lexical.Shard(row, np.array([2]), n_docs, 1 << 45)
    m = 10 + 90 * (1 << 30) * n_docs // (1 << 45)
    assert shard.scores.tolist() == [7000000000 // (7000 + 8 * m)]


def test_query_equals_its_sql(spark):
    assert not differences(op11_lexical(spark, SF), duckdb_over(SF), lexical.SQL)
