"""License scans: an exact set-similarity join of text blocks with license templates.

A text is cut into overlapping blocks of words. A block and a template join when the block holds
at least the template's share of distinct tokens. Tokens are ordered by their frequency over
all documents, rarest first. A template that needs ``o`` of its ``n`` tokens must share one of
its first ``n - o + 1`` with the block (prefix filter); the block must have ``o`` template tokens
at all (length filter); and what can still follow on both sides after the shared token must
suffice (positional filter). The survivors are counted exactly. Column functions only.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeworks.llm.common import id_and_text, staged

# Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices that are recognised by the tokens they contain.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
}
#: Share of a notice's distinct tokens that a block must hold; phrases need all of theirs.
CONTAINMENT = 0.85
#: Words of a block, and from one block's start to the next. No template is longer than a step.
BLOCK_WORDS = 48
STEP_WORDS = 24

#: Template words of a piece of a text. Those of a block are in the piece of any of them and its margins.
PIECE_HITS = 128

#: Columns of the templates' prefix tokens.
PREFIX = "token:string,template:int,place:int,n:int,needed:int,template_tokens:array<string>"

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    share: float
    phrase: bool  # the words must stand consecutively

    @property
    def tokens(self) -> set[str]:
        return set(self.words)

    @property
    def needed(self) -> int:
        return math.ceil(self.share * len(self.tokens) - 1e-9)


def templates() -> list[Template]:
    return [Template(label, tuple(text.split()), 1.0, True) for text, label in PHRASES.items()] + [
        Template(label, tuple(text.split()), CONTAINMENT, False) for text, label in NOTICES.items()
    ]


def _lowered(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def template_words(docs: DataFrame, known: list[Template]) -> DataFrame:
    """``doc_id``, ``n_words`` and ``hits``: places and tokens of the words that any template has."""
    vocabulary = sorted({w for t in known for w in t.words})
    either = sorted({*vocabulary, *(w.upper() for w in vocabulary), *(w.capitalize() for w in vocabulary)})
    words = F.split(F.trim(F.regexp_replace("text", _SEPARATORS, " ")), " ")
    # Longer words than the longest token are none of them; the others are put in lower case.
    longest = max(map(len, vocabulary))
    placed = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w")))
    short = F.filter(placed, lambda x: x["w"].isin(either) | ((F.octet_length(x["w"]) <= longest) & x["w"].rlike("[A-Z]")))
    lower = F.transform(short, lambda x: F.struct(x["i"].alias("i"), _lowered(x["w"]).alias("w")))
    return id_and_text(docs).select(
        "doc_id",
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"),
        F.filter(lower, lambda x: x["w"].isin(vocabulary)).alias("hits"),
    )


def frequencies(hits: DataFrame) -> dict[str, int]:
    """Occurrences of each template token over all documents; one row per token of the templates."""
    counted = hits.select(F.explode("hits.w").alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counted.collect()}


def _joined(hits: DataFrame, known: list[Template], order: list[str]) -> DataFrame:
    """(``row``, ``block``, ``template``, ``tokens``) where the block holds what the template needs."""
    spark = hits.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for number, t in enumerate(known):
        ordered = sorted(t.tokens, key=rank.__getitem__)
        for place, token in enumerate(ordered[: len(ordered) - t.needed + 1]):
            prefixes.append(
                {
                    "token": token,
                    "template": number,
                    "place": place,
                    "n": len(ordered),
                    "needed": t.needed,
                    "template_tokens": ordered,
                }
            )
    # As many rows as the templates have prefix tokens.
    listed = F.from_json(F.lit(json.dumps(prefixes)), f"array<struct<{PREFIX}>>")
    prefix = F.broadcast(spark.range(1).select(F.inline(listed)))
    rare = sorted({p["token"] for p in prefixes})
    first = F.greatest(F.lit(0), F.floor((F.col("hit.i") - BLOCK_WORDS) / STEP_WORDS).cast("long") + 1)
    last = F.floor(F.col("hit.i") / STEP_WORDS).cast("long")
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / PIECE_HITS).cast("int")),
        lambda n: F.struct(
            F.slice("hits", n * PIECE_HITS + 1, F.lit(PIECE_HITS)).alias("own"),
            F.slice(
                "hits",
                F.greatest(F.lit(1), n * PIECE_HITS + 1 - BLOCK_WORDS),
                F.least(n * PIECE_HITS, F.lit(BLOCK_WORDS)) + PIECE_HITS + BLOCK_WORDS,
            ).alias("near"),
        ),
    )
    blocks = (
        hits.where(F.exists("hits", lambda x: x["w"].isin(rare)))
        .select("row", F.explode(pieces).alias("piece"))
        .select("row", "piece.own", F.col("piece.near").alias("hits"))
        .select("row", "hits", F.explode(F.filter("own", lambda x: x["w"].isin(rare))).alias("hit"))
        .select("row", "hits", F.col("hit.w").alias("token"), F.explode(F.sequence(first, last)).alias("block"))
        .withColumn(
            "tokens",
            F.array_distinct(
                F.transform(
                    F.filter("hits", lambda x: _inside(x["i"], F.col("block"))), lambda x: x["w"]
                )
            ),
        )
        .drop("hits")
        .withColumn("at", F.size(F.filter("tokens", lambda w: ranks[w] < ranks[F.col("token")])))
        .withColumn("size", F.size("tokens"))
    )
    candidates = blocks.join(prefix, "token").where(
        (F.col("size") >= F.col("needed"))
        & (1 + F.least(F.col("n") - F.col("place") - 1, F.col("size") - F.col("at") - 1) >= F.col("needed"))
    )
    overlap = F.size(F.array_intersect("tokens", "template_tokens"))
    return (
        candidates.withColumn("overlap", overlap)
        .where(F.col("overlap") >= F.col("needed"))
        .groupBy("row", "block", "template")
        .agg(F.max(F.col("overlap") / F.col("n")).alias("containment"))
    )


def _inside(place: Column, block: Column) -> Column:
    return (place >= block * STEP_WORDS) & (place < block * STEP_WORDS + BLOCK_WORDS)


def scan(docs: DataFrame) -> DataFrame:
    """Licenses of each row's whole text: one row per input row.

    ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (their smallest and
    largest start), ``base_labels``, ``labels`` (notices found by the join as well) and ``score``, the
    largest containment found (0 without any). Null and empty texts have no words; repeated
    rows are rows of their own; other columns are not looked at.
    """
    known = templates()
    if max(len(t.words) for t in known) > STEP_WORDS:
        raise ValueError("a template is longer than a step between blocks")
    hits = staged(
        template_words(docs, known).withColumn("row", F.monotonically_increasing_id()), "license-words"
    )
    seen = frequencies(hits)
    order = sorted({w for t in known for w in t.words}, key=lambda w: (seen.get(w, 0), w))
    joined = _joined(hits, known, order)
    names = F.array(*[F.lit(t.label) for t in known])
    found = joined.groupBy("row").agg(
        F.collect_set(F.struct("block", "template")).alias("blocks"),
        F.collect_set(names[F.col("template")]).alias("labels"),
        F.max("containment").alias("score"),
    )
    # A phrase's words also have to stand one after the other. The blocks of all its places are joined
    # with it, as a block holds every phrase that begins in its first step.
    rows = hits.join(found, "row", "left")
    places = F.concat(*[_places(n, t) for n, t in enumerate(known) if t.phrase])
    phrases = F.array(*[F.lit(n) for n, t in enumerate(known) if t.phrase])
    rows = rows.withColumn("places", F.when(F.col("blocks").isNotNull(), places))
    base = F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda p: names[p["t"]]))), F.array())
    # A phrase's tokens in any order are no license: its label stands only with a place.
    notices = F.coalesce(
        F.array_distinct(
            F.transform(
                F.filter("blocks", lambda b: ~F.array_contains(phrases, b["template"])),
                lambda b: names[b["template"]],
            )
        ),
        F.array(),
    )
    starts = F.transform("places", lambda p: p["i"])
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(base, notices))).alias("labels"),
        F.when((F.size(notices) > 0) | (F.size(base) > 0), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
    ).withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))


def _places(number: int, template: Template) -> Column:
    """Structs (t, i) of the starts of a phrase in a row joined with it: its words are neighbours in ``hits``."""

    def begins(x: Column, at: Column) -> Column:
        here = x["w"] == template.words[0]
        for k, word in enumerate(template.words[1:], 1):
            there = F.get("hits", at + k)
            here = here & (there["w"] == word) & (there["i"] == x["i"] + k)
        return here

    joined = F.exists("blocks", lambda b: b["template"] == number)
    starts = F.filter(F.when(joined, F.col("hits")).otherwise(F.slice("hits", 1, 0)), begins)
    return F.transform(starts, lambda x: F.struct(F.lit(number).alias("t"), x["i"].alias("i")))
