"""Text operators against plain re-statements of their rules."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeworks.llm import bpe, licenses, mixing, neardup, pii, quality, token_files
from lakeworks.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, row long, key long"
ODD = [
    None,
    "",
    " \t\n",
    "It's ΑΣΑΣ don't \x1c a\x1cb <|endoftext|>x İstanbul é ½ ٣٤ 日本語 🙂🙂 a　b",
    "a" * 3000,
    "word " * 40000,
    "''s 's' ve''ll <|endoftext| <<|endoftext|>>",
]


def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x", 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_encoding_and_decoding_equal_the_library(spark, library):
    docs = documents(spark, ODD + ["Same text."] * 2)
    found = {r.doc_id: r for r in bpe.round_trip(docs, vocabulary_path()).collect()}
    for i, text in enumerate(ODD + ["Same text."] * 2):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i].ids == ids
        assert found[i].decoded == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: r.decoded for i, r in found.items()}
    assert bpe.round_trip(docs.where("false"), vocabulary_path()).count() == 0


def test_token_files_give_back_every_id(spark, library, tmp_path):
    docs = documents(spark, ODD + ["b a", "b a"]).withColumn("doc_id", 100 - F.col("doc_id")).repartition(3)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, vocabulary_path(), 3 * token_files.FILE_TEXT_BYTES)
    rows = token_files.checksums(token_files.read_tokens(spark, path)).join(
        token_files.offsets(spark, path), ["part", "position"]
    )
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows.collect()}
    start, expected = 0, {}
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert found == expected


def test_row_numbers_are_written_once(spark):
    docs = documents(spark, PERSONAL)
    for result in (pii.scan(docs), pii.redacted(docs)):
        assert "monotonically_increasing_id" not in result._jdf.queryExecution().toString()


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def digits(match):
    return re.sub("[^0-9]", "", match)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def base_spans(text):
    found = [
        (m.start(), kind, m.end())
        for kind, (_, pattern, valid) in enumerate(RULES)
        for m in re.finditer(pattern, text)
        if valid(m.group())
    ]
    return ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found))


PERSONAL = [
    "a@b.c+d@e.f x@y a@b@c.d.e @ @@ a.b@c.d.",
    "é🙂 1.2.3.4.5 300.1.1.1 01.002.3.255 1.1.1 12.1.1.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 0000  000000000000",
    "+1 (017) 555-7713 +12 +1.2.3.4.5.6.7.8.9 +1 2 3 x +4411111111111111111111",
    "@@@ 1 2 3 " * 2000 + "z@z.zz",
    "a" * 20000 + "@",
]


def test_fixed_patterns_keep_their_spans(spark):
    texts = ODD + PERSONAL + PERSONAL[:1]
    found = {r.doc_id: r for r in pii.scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        expected = base_spans(text or "")
        assert found[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), text
        counts = Counter(s.split(":")[0] for s in expected.split(",") if s)
        assert [found[i][f"n_{k}"] for k, _, _ in RULES] == [counts[k] for k, _, _ in RULES]
    assert pii.scan(documents(spark, ODD).where("false")).count() == 0


def test_contexts_reveal_what_no_pattern_matches(spark):
    texts = [f"Please call me at +1 (212) 555-01{i:02d} soon" for i in range(40)]
    texts += [f"Please call me at 212-555-02{i:02d} soon" for i in range(2)] + ["The code of box 212-555-0300 here"]
    found = {r.doc_id: r for r in pii.scan(documents(spark, texts)).collect()}
    assert found[40].spans == "phone:18:30" and found[40].n_phone == 0
    assert found[42].spans == ""
    masked = {r.doc_id: r for r in pii.redacted(documents(spark, texts)).collect()}
    assert masked[0].text == masked[40].text == "Please call me at <phone> soon"
    assert masked[42].text == texts[42] and masked[40].n_chars == len(masked[40].text)
    assert masked[0].row == 5 and masked[0].spans == "x"


def test_licenses_against_a_plain_scan(spark):
    texts = ODD + [
        "Released UNDER the MIT license. under the mit license under",
        "Licensed under the Apache License, Version 2.0.",
        "x " * 23 + "CC-BY-NC cc by nc",
        "This work is licensed under the GNU General Public License, version 3.",
        "mit license the under",
        "İ under the mıt license, version 2 of nothing",
    ]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))
        starts = [
            (at, label)
            for phrase, label in licenses.PHRASES.items()
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        places = [s for s, _ in starts]
        row = found[i]
        assert (row.n_words, row.n_base) == (len(words), len(starts)), text
        assert (row.first_word, row.last_word) == (min(places, default=None), max(places, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in starts}))
    assert found[len(ODD) + 3].labels == "gpl-3" and found[len(ODD) + 4].labels == ""
    assert licenses.scan(documents(spark, ODD).where("false")).count() == 0


def test_quality_ranks_clean_text_first(spark):
    clean = [f"Sentence number {i} is written plainly, with commas and full stops." for i in range(200)]
    junk = [f"BUY!!! ### {i} ### NOW!!! $$$ $$$ ###" for i in range(50)]
    docs = documents(spark, clean + junk + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 200), "x") for i in range(250)], "doc_id long, quality int, text string")
    model = quality.train(docs, labels, F.col("doc_id") % 2 == 0)
    found = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert all((found[i] >= quality.DECISION) == (i < 200) for i in range(250))
    assert found[250] == found[251] and 0 <= found[250] <= 1
    kept = quality.kept_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(200))
    flat = quality.train(docs, labels.where("quality = 1"), F.lit(True))
    assert len({r.score for r in quality.scored(docs, flat).collect()}) == 1


def test_mixing_meets_targets_and_limits(spark):
    chance = np.random.default_rng(5)
    texts = [" ".join(["w"] * int(n)) for n in chance.integers(0, 900, 400)] + [None, "", "x y"]
    docs = documents(spark, texts).unionByName(documents(spark, texts[:2]))
    rows = mixing.mix(docs).taken().collect()
    assert len(rows) == docs.count()
    assert all(r.taken <= 3 * r.size for r in rows)
    goal = {(r.source_size, round(r.target)): 0 for r in rows}
    for r in rows:
        goal[r.source_size, round(r.target)] += r.taken
    assert all(abs(taken - target) <= 2 * mixing.BLOCK_WORDS for (_, target), taken in goal.items())
    again = mixing.mix(docs.repartition(5)).taken().collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(docs.where("false")).taken().count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_shares_are_poured_on_until_none_overflows():
    sizes, weights = {"a": 10, "b": 1000, "c": 1000}, {"a": 1.0, "b": 1.0, "c": 2.0}
    found = mixing.targets(sizes, weights)
    assert found["a"] == 30 and found["b"] == pytest.approx(1980 / 3) and found["c"] == pytest.approx(1320)
    assert sum(found.values()) == pytest.approx(2010)
    order = np.sort(mixing.permuted(np.arange(1000), 1000, 3))
    assert (order == np.arange(1000)).all()


def test_classes_are_those_of_brute_force(spark):
    chance = np.random.default_rng(11)
    names = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(40):
        words = list(chance.choice(names, 200))
        texts.append(" ".join(words))
        for edits in (0, 1, 2, 3, 8, 40):
            copy = list(words)
            for at in chance.choice(200, edits, replace=False):
                copy[at] = "new"
            texts.append(" ".join(copy).upper() if edits == 0 else " ".join(copy))
    texts += [None, "", "...", "two words", "Two, words!", "three short words", "a " * 3000]
    docs = documents(spark, texts)
    found = {r.doc_id: r for r in neardup.classes(docs).collect()}

    def shingle_set(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return Counter(tuple(words[i : i + 5]) for i in range(max(min(1, len(words)), len(words) - 4)))

    sets = [shingle_set(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            either = (a | b).total()
            alike = (a & b).total() / either if either else 1.0
            same = found[i].class_id == found[j].class_id
            if alike >= 0.85:
                assert same, (i, j, alike)
            if alike < 0.5:
                assert not same, (i, j, alike)
    kept = neardup.kept_documents(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in found.values()})
    assert neardup.classes(docs.where("false")).count() == 0


def test_chunks_of_large_buckets_lose_nothing(spark, monkeypatch):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join([*base[:-1], f"end{i}"]) for i in range(60)] + [" ".join(f"o{i}_{j}" for j in range(50)) for i in range(5)]
    monkeypatch.setattr(neardup, "BUCKET_CHUNK", 8)
    monkeypatch.setattr(neardup, "FAMILY_CHUNK", 8)
    found = {r.doc_id: r.class_id for r in neardup.classes(documents(spark, texts)).collect()}
    assert {found[i] for i in range(60)} == {0} and [found[i] for i in range(60, 65)] == list(range(60, 65))


def test_accepted_candidates_are_seeds_of_further_patterns(spark):
    rows = [(3, "reach me", f"+1{i}", True) for i in range(20)]
    rows += [(3, "reach me", f"5{i}", False) for i in range(2)]
    # Both share a context that no base seed has, with a third; so it goes on for one more hop.
    rows += [(3, "desk line", f"5{i}", False) for i in range(2)] + [(3, "desk line", f"5{i}", False) for i in range(10, 11)]
    rows += [(3, "reach me", f"6{i}", False) for i in range(2)] + [(3, "desk line", f"6{i}", False) for i in range(2)]
    rows += [(3, "night shift", "510", False), (3, "never seen", "999", False)]
    # Two contexts with two seeds each are enough together.
    rows += [(3, f"few {i}", f"+2{i}{j}", True) for i in range(2) for j in range(2)]
    rows += [(3, f"few {i}", "700", False) for i in range(2)]
    mentions = spark.createDataFrame(rows, "kind int, pattern string, instance string, seed boolean")
    assert {r.instance for r in pii.sure_candidates(mentions).collect()} == {"50", "51", "60", "61", "510", "700"}


def test_contexts_of_one_word_of_lists_and_after(spark):
    texts = [f"Phone: +1 (212) 555-01{i:02d}\nmore" for i in range(40)]
    texts += [f"write a@b{i}.org (work account)" for i in range(40)]
    texts += ["Phone: 212-555-0200, 212-555-0201, 212-555-0202\nmore", "xx\nPhone: 212-555-0203\nmore"]
    texts += ["card 4111111111111111 ok"]
    texts += ["1 " * 40 + "bob (at) site (dot) org (work account)", "Phone 1: x\n" + "212-555-0300 zz"]
    texts += [f"my card {n} is" for n in CARDS] + ["my card 123456789012 is"]
    found = {r.doc_id: r.spans for r in pii.scan(documents(spark, texts)).collect()}
    assert found[80] == "phone:7:19,phone:21:33,phone:35:47" and found[81] == "phone:10:22"
    assert found[83] == "email:80:103" and found[84] == ""
    assert found[len(texts) - 1] == "card:8:20"


def test_row_numbers_are_written_once(spark):
    docs = documents(spark, PERSONAL)
    for result in (pii.scan(docs), pii.redacted(docs)):
        assert "monotonically_increasing_id" not in result._jdf.queryExecution().toString()


def luhn(digits):
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits), 1))
    return total % 10 == 0


CARDS = [n for n in map(str, range(4111111111110000, 4111111111110400)) if luhn(n)]


def test_a_hot_labelled_id_gives_bounded_training_rows(spark):
    docs = documents(spark, [f"text {i}" for i in range(10)])
    hot = docs.where("doc_id = 3").crossJoin(spark.range(90)).drop("id")
    other = hot.withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id()))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    rows = quality.training_rows(docs.unionByName(hot), labels, "quality", F.lit(True), 20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(10))
    rows = quality.training_rows(docs.unionByName(other), labels, "quality", F.lit(True), 20).collect()
    assert len(rows) == 20 and {r.doc_id for r in rows} == set(range(10))


def test_repeated_memory_gives_the_ids_of_the_library(library):
    texts = ["The cat's Hat, the cat's hat!", "", "x" * 50, "ÄÖ ß Σας ab12 <|endoftext|> THE", "the the The", "a b"]
    texts += [f"w{i} word{i % 7} rare{i * 7919} Tail." for i in range(300)]
    memory = token_files._memory(vocabulary_path())
    for _ in range(3):
        ids, lengths = memory.ids(texts)
        found = np.split(ids, np.cumsum(lengths)[:-1])
        assert [f.tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(memory.chunks.start) == len(memory.chunks.codes) and b"rare7919" in memory.chunks.codes
