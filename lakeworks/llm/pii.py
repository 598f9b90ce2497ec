"""Personal data: fixed patterns, and identifiers found by bootstrapping their contexts.

Seeds are what the fixed patterns find. The words next to a seed make lexical patterns: the last
two before it and the last one, the first two after it and the first one, with the line's start
and end counting as words.
Candidates are strings of a looser shape that no seed covers, with patterns from their own
contexts. Seeds count as certain; a pattern is as sure as the share of sure instances among all
it occurs with, an instance as sure as one of its patterns at least being right. The two are
computed in turn over the graph of patterns and instances, and candidates that end up sure
enough join the seeds, from which it all begins anew until none joins. Column functions, joins and grouping only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.llm.common import staged, whole

KINDS = ("email", "ip", "card", "phone")
# Where a run of address characters begins, or right after the previous match: the leftmost
# match begins there, and no other start has to be tried. Repetitions never give back.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# Fewer than twelve digits are no card, so only longer runs are looked at.
_CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
#: A quick test that a text may have a match at all.
_HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
_QUICK = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"}
# Looser shapes: written-out addresses, eight groups of hexadecimal digits, digits that fail the
# checksum, numbers without a country.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at )"
    r" ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": _CARD,
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])",
}
_LOOSE_QUICK = {
    "email": r"[(\[ ]dot[)\] ]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "card": _QUICK["card"],
    "phone": r"[0-9][ .-][0-9]{3}",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Characters of context that are kept, words of it that make a pattern.
CONTEXT_CHARS = 48
CONTEXT_WORDS = 2
#: Rounds of scoring before candidates are accepted, and the confidence to accept.
ROUNDS = 3
ACCEPT = 0.9
#: Characters of a block of text, and spans of a piece, that are worked on together in one text.
BLOCK_CHARS = 1024
PIECE_SPANS = 256


def _found(kind: str, pattern: str, hint: Column) -> Column:
    """Structs (kind, pieces before, matches) of one pattern; nulls where the hint rules it out."""
    text = F.col("text")
    return F.when(
        hint,
        F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.split(text, pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        ),
    )


def _hint(kind: str) -> Column:
    return F.contains("text", F.lit(_HINTS[kind])) if _HINTS[kind] else F.col("text").rlike(_QUICK[kind])


def _mentions(rows: DataFrame) -> DataFrame:
    """Every match of every pattern: ``row``, ``loose``, ``kind``, ``value``, ``before`` and ``after`` (context), place.

    The pieces between matches and the matches alternate, so places are running sums of their
    lengths, taken per row, pattern and kind. A list has its context at its ends: what lies
    between two matches and holds no words is passed over.
    """
    found = F.array(
        *[F.struct(F.lit(False).alias("loose"), _found(k, PATTERNS[k], _hint(k)).alias("f")) for k in KINDS],
        *[
            F.struct(F.lit(True).alias("loose"), _found(k, LOOSE[k], F.col("text").rlike(_LOOSE_QUICK[k])).alias("f"))
            for k in KINDS
            if k != "card"
        ],
    )
    some = F.filter(found, lambda x: x["f"].isNotNull() & (F.size(x["f"]["matches"]) > 0))
    # By row alone: what follows is taken per row and needs no other shuffle.
    matches = (
        rows.select("row", F.explode(some).alias("x"))
        .select(
            "row",
            "x.loose",
            "x.f.kind",
            F.posexplode(
                F.transform(
                    F.col("x.f.matches"),
                    lambda m, i: F.struct(
                        m.alias("value"),
                        F.length(F.col("x.f.pieces")[i]).alias("gap"),
                        _last_words(F.col("x.f.pieces")[i], i == 0).alias("before"),
                        _first_words(F.col("x.f.pieces")[i + 1], i == F.size("x.f.matches") - 1).alias("after"),
                    ),
                )
            ).alias("at", "m"),
        )
        .select("row", "loose", "kind", "at", "m.value", "m.gap", "m.before", "m.after")
        .repartition("row")
    )
    parts = Window.partitionBy("row", "loose", "kind")
    place, back = parts.orderBy("at"), parts.orderBy(F.desc("at"))
    # Growing frames only, the following ones in reverse: each takes one step per match.
    up_to = place.rowsBetween(Window.unboundedPreceding, 0)
    on = back.rowsBetween(Window.unboundedPreceding, 0)
    none = F.expr("cast(array() AS array<string>)")
    # A piece with words, and those of the next such piece further away.
    further = F.last(_some("before"), True).over(place.rowsBetween(Window.unboundedPreceding, -1))
    beyond = F.last(_some("after"), True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    matches = matches.withColumns(
        {
            "left": F.concat(F.coalesce(further, none), _some("before")),
            "right": F.concat(_some("after"), F.coalesce(beyond, none)),
            "end": F.sum(F.col("gap") + F.length("value")).over(up_to),
        }
    )
    return matches.select(
        "row",
        "loose",
        "kind",
        "value",
        F.coalesce(F.last("left", True).over(up_to), none).alias("before"),
        F.coalesce(F.last("right", True).over(on), none).alias("after"),
        (F.col("end") - F.length("value")).alias("start"),
        "end",
    )


def _some(words: str) -> Column:
    return F.when(F.size(words) > 0, F.col(words))


def _tokens(text: Column) -> Column:
    """Words, letters only, and line breaks."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\n"), F.lit(0))


def _last_words(piece: Column, first: Column) -> Column:
    """The last words of a piece; the text's start counts as a line break."""
    near = F.right(piece, F.lit(CONTEXT_CHARS))
    words = _tokens(F.when(first & (F.length(piece) <= CONTEXT_CHARS), F.concat(F.lit("\n"), near)).otherwise(near))
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - CONTEXT_WORDS + 1), F.lit(CONTEXT_WORDS))


def _first_words(piece: Column, last: Column) -> Column:
    near = F.left(piece, F.lit(CONTEXT_CHARS))
    words = _tokens(F.when(last & (F.length(piece) <= CONTEXT_CHARS), F.concat(near, F.lit("\n"))).otherwise(near))
    return F.slice(words, 1, CONTEXT_WORDS)


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid() -> Column:
    """Whether a match of a fixed pattern is what its kind asks for."""
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    card = (n >= 12) & (n <= 19) & _luhn(F.when(n <= 19, digits).otherwise(F.lit("1")))
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.col("value").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(F.col("kind") == 2, card)
        .otherwise((n >= 9) & (n <= 15))
    )


def _with_patterns(mentions: DataFrame) -> DataFrame:
    """The lexical patterns of a mention, and its instance.

    ``a b<`` and ``b<`` are the words before, ``>c d`` and ``>c`` those after; a line break ends them.
    """
    word = lambda w: F.when(w == "\n", F.lit("^")).otherwise(w)
    last, one_before = F.try_element_at("before", F.lit(-1)), F.try_element_at("before", F.lit(-2))
    first, one_after = F.try_element_at("after", F.lit(1)), F.try_element_at("after", F.lit(2))
    patterns = F.array(
        F.concat(word(last), F.lit("<")),
        F.when(last != "\n", F.concat(word(one_before), F.lit(" "), last, F.lit("<"))),
        F.concat(F.lit(">"), word(first)),
        F.when(first != "\n", F.concat(F.lit(">"), first, F.lit(" "), word(one_after))),
    )
    return mentions.withColumns(
        {
            "patterns": F.filter(patterns, lambda p: p.isNotNull()),
            "instance": F.lower(F.regexp_replace("value", r"[\s().-]+", "")),
        }
    )


def sure_candidates(mentions: DataFrame) -> DataFrame:
    """Instances (``kind``, ``instance``) that the pattern-instance graph makes sure.

    ``mentions`` has ``kind``, ``pattern``, ``instance`` and ``seed``. A round reaches the patterns
    of all instances that have any confidence so far. Edges are distinct; a pattern that occurs
    with very many instances is aggregated before it is shuffled. Patterns that share
    the word next to the instance are no independent evidence: the best of them counts.
    """
    edges = staged(
        mentions.where(F.col("pattern").isNotNull())
        .groupBy("kind", "pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "pii-graph",
    )
    sizes = staged(edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
    instances = edges.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
    seeds = staged(instances.where("seed").select("kind", "instance"), "pii-seeds")
    accepted, n = seeds, seeds.count()
    while n:
        certain = accepted.withColumn("certain", F.lit(1.0))
        sure = certain.withColumnRenamed("certain", "sure")
        for _ in range(ROUNDS):
            # One row's worth of doubt keeps a rare pattern from being certain.
            patterns = (
                edges.join(sure, ["kind", "instance"])
                .groupBy("kind", "pattern")
                .agg(F.sum("sure").alias("sure"))
                .join(sizes, ["kind", "pattern"])
                .select("kind", "pattern", (F.col("sure") / (F.col("n") + 0.25)).alias("trust"))
            )
            doubt = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("trust"))))
            first, last = F.substring_index("pattern", " ", 1), F.substring_index("pattern", " ", -1)
            near = F.when(F.col("pattern").startswith(">"), first).otherwise(last)
            scored = (
                edges.join(patterns, ["kind", "pattern"])
                .groupBy("kind", "instance", near.alias("near"))
                .agg(F.max("trust").alias("trust"))
                .groupBy("kind", "instance")
                .agg((1 - F.exp(doubt)).alias("sure"))
                .join(certain, ["kind", "instance"], "left")
            )
            sure = staged(scored.select("kind", "instance", F.coalesce("certain", "sure").alias("sure")), "pii-scores")
        accepted = sure.where(F.col("sure") >= ACCEPT).select("kind", "instance")
        before, n = n, accepted.count()
        if n == before:
            break
    return accepted.join(seeds, ["kind", "instance"], "left_anti")


def _uncovered(mentions: DataFrame) -> DataFrame:
    """Seeds, and the candidates that share no character with a seed: one pass over a row's mentions.

    A candidate overlaps a seed if one of those that begin before its end reaches past its start.
    """
    at = F.when(F.col("valid"), F.col("start")).otherwise(F.col("end"))
    earlier = Window.partitionBy("row").orderBy(at, "valid").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("valid"), F.col("end"))).over(earlier)
    free = F.col("valid") | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))
    return mentions.withColumn("reach", reach).where(free).drop("reach")


def find(rows: DataFrame) -> DataFrame:
    """``row``, ``base`` and ``spans``: arrays of (start, kind, end) of each row with any.

    ``rows`` has a unique ``row`` and a ``text`` without nulls. ``base`` are the valid matches of the
    fixed patterns; ``spans`` has the accepted candidates too, where they overlap no base span.
    Places count code points; ends are exclusive.
    """
    mentions = _mentions(rows).withColumn("valid", ~F.col("loose") & _valid())
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    # A number that fails the checksum is a candidate card.
    candidate = F.col("loose") | ((F.col("kind") == 2) & ~F.col("valid") & digits.between(12, 19))
    mentions = _uncovered(mentions.where(F.col("valid") | candidate))
    mentions = staged(_with_patterns(mentions).drop("before", "after", "value", "loose"), "pii-mentions")
    sure = sure_candidates(
        mentions.select("kind", "instance", F.col("valid").alias("seed"), F.explode("patterns").alias("pattern"))
    )
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"))
    base = mentions.where("valid").select("row", F.lit(True).alias("is_base"), span.alias("span"))
    more = mentions.where(~F.col("valid")).join(sure, ["kind", "instance"])
    more = more.select("row", F.lit(False).alias("is_base"), span.alias("span"))
    both = base.unionByName(more).groupBy("row").agg(F.collect_set(F.struct("is_base", "span")).alias("all"))
    fixed = F.transform(F.filter("all", lambda x: x["is_base"]), lambda x: x["span"])
    added = F.transform(F.filter("all", lambda x: ~x["is_base"]), lambda x: x["span"])
    return both.select(
        "row", F.array_sort(fixed).alias("base"), F.array_sort(F.concat(fixed, added)).alias("spans")
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """``document`` and ``row``, its number, written once: computed again it could count other partitions."""
    return staged(whole(docs, F.monotonically_increasing_id().alias("row")), "pii-rows")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    )


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each row's whole text: one row per input row.

    ``n_email`` ... count the base spans; ``base_sha256`` is the digest of the base spans, ``spans``
    the text of all. Null and empty texts have none; repeated rows are rows of their own.
    """
    rows = _numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("document.*", "row")
    found = rows.select("row", "doc_id").join(find(rows), "row", "left")
    base = F.coalesce("base", F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    counts = [_count(base, i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(base), 256).alias("base_sha256"),
        F.coalesce(_written(F.col("spans")), F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, set anew.

    Of overlapping spans the first stays (the longer of two with one start). All other columns
    and all rows are kept.
    """
    rows = _numbered(docs)
    spans = find(rows.select("row", F.coalesce("document.text", F.lit("")).alias("text")))
    joined = rows.join(spans.select("row", _apart(F.col("spans")).alias("kept")), "row", "left")
    own = F.col("document.text")
    # Pieces are cut out of the block they lie in: cutting from the whole text would read it once a span.
    blocks = F.when(F.size("kept") > 0, F.regexp_extract_all(own, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0)))
    joined = joined.withColumn("blocks", blocks)
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    parts = F.transform(
        "kept",
        lambda s, i: F.concat(
            _between(F.when(i > 0, F.col("kept")[i - 1]["end"]).otherwise(F.lit(0)), s["start"]), names[s["kind"]]
        ),
    )
    tail = _between(F.element_at("kept", -1)["end"], F.length(own))
    text = F.when(F.size("kept") > 0, F.concat(F.concat_ws("", parts), tail)).otherwise(own)
    done = joined.select("document", text.alias("text"))
    columns = [
        F.col("text")
        if c == "text"
        else F.length("text").cast("long").alias(c)
        if c == "n_chars"
        else F.col(f"document.`{c}`")
        for c in docs.columns
    ]
    return done.select(*columns)


def _apart(spans: Column) -> Column:
    """Of ordered spans those that begin where the last one kept has ended, or later.

    Taken in pieces, as an array that grows by one element at a time is copied each time.
    """
    span = "struct<start:bigint,kind:int,end:bigint>"

    def add(state: Column, s: Column) -> Column:
        longer = F.struct(s["end"].alias("end"), F.concat(state["kept"], F.array(s)).alias("kept"))
        return F.when(s["start"] >= state["end"], longer).otherwise(state)

    def add_piece(state: Column, piece: Column) -> Column:
        empty = F.struct(state["end"].alias("end"), F.expr("array()").cast(f"array<{span}>").alias("kept"))
        grown = lambda x: F.struct(x["end"].alias("end"), F.concat(state["kept"], F.array(x["kept"])).alias("kept"))
        return F.transform(F.array(F.aggregate(piece, empty, add)), grown)[0]

    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / PIECE_SPANS).cast("int")),
        lambda i: F.slice(spans, i * PIECE_SPANS + 1, F.lit(PIECE_SPANS)),
    )
    start = F.expr("named_struct('end', 0L, 'kept', array())").cast(f"struct<end:bigint,kept:array<array<{span}>>>")
    return F.flatten(F.aggregate(pieces, start, add_piece)["kept"])


def _between(start: Column, end: Column) -> Column:
    """Characters of a text that is there in ``blocks`` of ``BLOCK_CHARS``."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    last = F.floor((end - 1) / BLOCK_CHARS).cast("int")
    near = F.array_join(F.slice("blocks", first + 1, last - first + 1), "")
    return F.substring(near, (start - first * BLOCK_CHARS).cast("int") + 1, (end - start).cast("int"))
