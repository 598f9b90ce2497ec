"""Clashing column names, rows that differ beside their text, huge components, and very long texts."""

from __future__ import annotations

import random
import re

import pytest

from lakeworks.llm import licenses, mixing, mtree, neardup, pii

NAMES = """_id _key _n _doc_id _tie _parts _size _pii_row _own document row kept own key n blocks tie size
parts id class_id start end spans""".split()
COLUMNS = ["doc_id", "text", "source", *NAMES]


def documents(spark, *rows):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*row, *NAMES) for row in rows], schema)


@pytest.mark.parametrize("stage", [neardup.kept_documents, pii.redacted, mixing.mixed_documents])
def test_no_column_name_clashes(spark, stage):
    docs = documents(spark, (1, "a b c d e f", "s1"), (1, "a b c d e f", "s1"), (2, "write to x@y.org", "s2"), (3, None, None))
    out = stage(docs)
    rows = out.collect()
    assert out.columns == COLUMNS and rows
    assert all(r[n] == n for r in rows for n in NAMES)


def test_repeated_rows_leave_the_first_by_all_columns(spark):
    rows = [(1, "a b c d e f", "s2"), (1, "a b c d e f", "s1"), (1, "a b c d e f", "s3")]
    for order in (rows, rows[::-1]):
        kept = neardup.kept_documents(documents(spark, *order).repartition(3)).collect()
        assert [(r.doc_id, r.source) for r in kept] == [(1, "s1")]


def test_a_mix_keeps_every_row_with_its_source(spark):
    text = " ".join(f"w{i}" for i in range(600))
    docs = documents(spark, (1, text, "s1"), (1, text, "s2"), (2, text, "s2"))
    words = {}
    for r in mixing.mixed_documents(docs).collect():
        words[(r.doc_id, r.source)] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
    # Targets: a third and two thirds of 1800 words, as much as each source has.
    by_source = {s: sum(n for (_, x), n in words.items() if x == s) for s in ("s1", "s2")}
    assert by_source == {"s1": 600, "s2": 1200}
    assert words[(1, "s1")] == 600


def test_huge_components_take_no_part_in_exact_search(spark):
    vectors = [(0, [1e9, 1.0]), (20, [1e300, 1.0]), (1, [1.0, 2.0]), (40, [3e7, 2.0]), (60, [1e308, -1e308]), (2, [4e7, 0.0])]
    found = mtree.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    score = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    v = dict(vectors)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [
        (40, 1, 2, score(v[40], v[2])),
        (40, 2, 1, score(v[40], v[1])),
    ]


def test_redacting_cuts_where_spans_are_over_block_borders(spark):
    chance = random.Random(5)
    pieces, expected = [], []
    for i in range(700):
        plain = "é𝄞 word\n"[: chance.randrange(1, 9)] + "x" * chance.randrange(0, 40) + " "
        pieces += [plain, f"a{i}@b{i}.org", " "]
        expected += [plain, "<email>", " "]
    docs = spark.createDataFrame([(1, "".join(pieces)), (2, "none"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {1: "".join(expected), 2: "none", 3: None}


def test_spans_that_overlap_leave_the_first(spark):
    chance = random.Random(7)
    spans = sorted({(chance.randrange(3000), chance.randrange(4)) for _ in range(1200)})
    spans = [(s, k, s + chance.randrange(1, 9)) for s, k in spans]
    kept, end = [], 0
    for s in spans:
        if s[0] >= end:
            kept.append(s)
            end = s[2]
    df = spark.createDataFrame([(spans,), ([],)], "spans array<struct<start:bigint,kind:int,end:bigint>>")
    found = [[tuple(s) for s in r.kept] for r in df.select(pii._apart(df.spans).alias("kept")).collect()]
    assert found == [kept, []]


def test_candidates_under_a_seed_are_dropped(spark):
    chance = random.Random(3)
    rows = [(chance.randrange(3), chance.random() < 0.4, a := chance.randrange(400), a + chance.randrange(1, 12)) for _ in range(600)]
    seeds = [r for r in rows if r[1]]
    free = [r for r in rows if not r[1] and not any(s[0] == r[0] and s[2] < r[3] and r[2] < s[3] for s in seeds)]
    df = spark.createDataFrame(rows, "row long, valid boolean, start long, end long")
    assert sorted(map(tuple, pii._uncovered(df).collect())) == sorted(seeds + free)


def test_one_very_long_text_of_numbers(spark):
    docs = spark.createDataFrame([(0, " ".join(f"+1 212 {i:06d} x" for i in range(20_000)))], "doc_id long, text string")
    (found,) = pii.scan(docs).collect()
    assert found.n_phone == 20_000
    (clean,) = pii.redacted(docs).collect()
    assert clean.text == " ".join(["<phone> x"] * 20_000)


def test_places_of_phrases_and_notices_in_long_texts(spark):
    chance = random.Random(11)
    words = "under the mit license apache version 2 cc by nc released x y z".split()
    texts = [" ".join(chance.choice(words) for _ in range(n)) for n in (0, 5, 127, 128, 129, 900, 4000)]
    texts += ["released under the mit license and " * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        split = re.findall(r"[a-z0-9]+", text)
        starts = [
            (at, label)
            for phrase, label in licenses.PHRASES.items()
            for at in range(len(split))
            if split[at : at + len(phrase.split())] == phrase.split()
        ]
        assert found[i].n_base == len(starts)
        assert found[i].first_word == min((a for a, _ in starts), default=None)
        assert found[i].last_word == max((a for a, _ in starts), default=None)
        assert found[i].base_labels == ",".join(sorted({x for _, x in starts}))
        # Every block against every notice.
        labels = {x for _, x in starts}
        for begin in range(0, len(split), licenses.STEP_WORDS):
            block = set(split[begin : begin + licenses.BLOCK_WORDS])
            labels |= {
                t.label for t in licenses.templates() if not t.phrase and len(t.tokens & block) >= t.needed
            }
        assert found[i].labels == ",".join(sorted(labels))
