"""Seeded synthetic transactions, from fixed domains or learned from a table.

Every value is an expression over the row's key, so rows can be made anywhere, in any number,
and again after a lost executor, with the same result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeworks.functions.columns import by_bounds, iso_text, parse_ts
from lakeworks.functions.hashing import pick, pick_weighted, uniform, uniform_int
from lakeworks.schemas import RAW_COLUMNS
from lakeworks.sources.scratch import new_folder

# The domains of the transaction columns.
TRANSACTION_TYPES = ["DEBIT", "CREDIT", "TRANSFER", "UPI", "NEFT", "RTGS", "IMPS"]
CHANNELS = ["ATM", "UPI", "NEFT", "MOBILE", "BRANCH", "INTERNET"]
MERCHANT_CATEGORIES = [
    "GROCERY",
    "FUEL",
    "RESTAURANT",
    "ECOMMERCE",
    "UTILITIES",
    "HEALTHCARE",
    "TRAVEL",
    "INSURANCE",
    "SALARY",
    "LOAN_REPAYMENT",
]
STATUS_WEIGHTS = {"SUCCESS": 0.92, "FAILED": 0.05, "PENDING": 0.03}

# A column of more distinct values keeps their shares in a table, not in an expression.
MAX_CATEGORIES = 1000
# Normal scores: how finely numbers are told apart when correlations are learned, and the
# table that turns scores back into numbers. Defaults of ``learn`` and ``sample``.
NORMAL = NormalDist()
SCORE_BINS = 32
SCORE_STEPS = 1000
MAX_SCORE = 5.0
# Equally likely stretches of a category's scores; a value is drawn within the stretch.
CATEGORY_BINS = 64
# Up to so many values are looked up in an array of the plan, more by a join.
LISTED_VALUES = 64
# Columns that correlate with no other by as much are drawn on their own.
LEAST_CORRELATION = 0.02


def synthetic_transactions(ids: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """One raw transaction per key, all 14 columns, drawn evenly from the fixed domains."""
    k = F.xxhash64(F.col(key), F.lit(seed))
    day = F.date_add(F.lit("2024-01-01").cast("date"), uniform_int(k, "day", 0, 730).cast("int"))
    clock = F.format_string(
        "T%02d:%02d:00", uniform_int(k, "hour", 0, 23), uniform_int(k, "minute", 0, 59)
    )
    columns = {
        "transaction_id": _uuid(F.concat_ws(":", F.lit(seed), F.col(key))),
        "account_id": F.concat(F.lit("ACC"), uniform_int(k, "account", 100000, 999999)),
        "customer_id": F.concat(F.lit("CUST"), uniform_int(k, "customer", 10000, 99999)),
        "transaction_type": pick(k, "type", TRANSACTION_TYPES),
        "amount": F.round(F.lit(10.0) + uniform(k, "amount") * F.lit(499990.0), 2),
        "currency": F.lit("INR"),
        "merchant_name": F.concat(F.lit("Merchant_"), uniform_int(k, "merchant", 1, 5000)),
        "merchant_category": pick(k, "category", MERCHANT_CATEGORIES),
        "channel": pick(k, "channel", CHANNELS),
        "transaction_ts": F.concat(day.cast("string"), clock),
        "branch_code": F.concat(F.lit("BR"), uniform_int(k, "branch", 100, 999)),
        "status": pick_weighted(k, "status", STATUS_WEIGHTS),
        "balance_after": F.round(uniform(k, "balance") * F.lit(2000000.0), 2),
        "country_code": F.lit("IN"),
    }
    return ids.select(*[columns[c].alias(c) for c in RAW_COLUMNS])


def _uuid(text: Column) -> Column:
    digest = F.md5(text)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in parts])


# ---- learned from a table: a Gaussian copula over its columns


@dataclass(frozen=True)
class Shares:
    """Value shares of a column with many values, as a table.

    The rows that hold a value are numbered from 0 to ``total``, value by value. ``table`` has a row
    for each value and each cell (``width`` numbers) it reaches into: ``cell``, ``first``, ``end``
    (excluded) and ``value``. There are about as many cells as values, so a cell is met by few
    rows and a frequent value is spread over many cells.
    """

    table: DataFrame
    total: int
    width: int


@dataclass(frozen=True)
class Profile:
    """Distribution of each column and the correlation between them.

    ``grids`` holds evenly spaced quantiles of the numeric columns (``times`` among them, in
    seconds since 1970), ``shares`` the share of each value of the categorical ones, most
    frequent first. Their size is bounded; ``tables`` are the shares of columns with more values.
    ``correlation`` is that of the normal scores of ``correlated`` columns.
    ``nulls`` is the share of nulls by column. ``ids`` are made anew for every row.
    """

    grids: Mapping[str, Sequence[float]] = field(default_factory=dict)
    shares: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    correlation: np.ndarray | None = None
    tables: Mapping[str, Shares] = field(default_factory=dict)
    nulls: Mapping[str, float] = field(default_factory=dict)
    times: Sequence[str] = ()
    ids: Sequence[str] = ()

    @property
    def correlated(self) -> list[str]:
        return [*self.grids, *self.shares]

    @property
    def columns(self) -> list[str]:
        return [*self.correlated, *self.tables, *self.ids]


def learn(
    df: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    steps: int = 100,
    times: Sequence[str] = (),
    ids: Sequence[str] = (),
    bins: int = SCORE_BINS,
    max_categories: int = MAX_CATEGORIES,
) -> Profile:
    """Learn a profile: one pass for the quantiles, one for the shares, one for correlations.

    Every pass is a plain aggregate that combines per task. What reaches the driver is ``steps``
    numbers per numeric column and at most ``max_categories`` values per category; a column with
    more values stays in a table and is drawn on its own. ``bins`` is how many levels of a number
    the correlations tell apart. Columns of ``ids`` are not looked at.
    """
    scored = [*numeric, *times]
    df = df.select(
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[parse_ts(c).cast("double").alias(c) for c in times],
        *[F.col(c).cast("string").alias(c) for c in categorical],
    )
    probabilities = [i / steps for i in range(steps + 1)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"n_{c}") for c in scored],
        *[F.percentile_approx(c, probabilities, 10000).alias(f"q_{c}") for c in scored],
    ).first()
    grids = {c: list(row[f"q_{c}"] or []) for c in scored}
    shares, tables, totals = _value_shares(df, categorical, max_categories)
    present = {c: row[f"n_{c}"] for c in scored} | totals
    nulls = {c: 1 - n / row["rows"] for c, n in present.items()} if row["rows"] else {}
    found = Profile(grids, shares, None, tables, nulls, tuple(times), tuple(ids))
    return replace(found, correlation=_score_correlation(df, found, bins))


def sample(
    ids: DataFrame, profile: Profile, key: str = "id", seed: int = 0, max_score: float = MAX_SCORE
) -> DataFrame:
    """One row per key with the profile's columns, distributed and correlated like the source.

    Normal scores beyond ``max_score`` count as that: with 5, one draw in 1.7 million.
    """
    k = F.xxhash64(F.col(key), F.lit(seed))
    linked, root = _linked(profile)
    rows = ids.select(key)
    # First, while rows are a key: what is drawn besides follows from the key and need not be shuffled.
    for c, t in profile.tables.items():
        cells = t.table.select([F.col(n).alias(f"_{n}_{c}") for n in ("cell", "first", "end", "value")])
        # The place is a column of its own, not hashed again for every value it is compared with.
        rows, at = rows.withColumn("_at", uniform_int(k, f"place:{c}", 0, t.total - 1)), F.col("_at")
        met = F.floor(at / t.width) == F.col(f"_cell_{c}")
        rows = rows.join(cells, met & (at >= F.col(f"_first_{c}")) & (at < F.col(f"_end_{c}")))
        rows = rows.drop("_at", *[f"_{n}_{c}" for n in ("cell", "first", "end")])
    drawn = rows.withColumns(
        _compiled({"_k": k} | {f"e{i}": _normal_draw(k, f"noise:{c}") for i, c in enumerate(linked)}, F.col(key))
    )
    scores = {
        c: sum((F.col(f"e{j}") * F.lit(float(w)) for j, w in enumerate(root[i]) if w), F.lit(0.0))
        for i, c in enumerate(linked)
    }
    rows = drawn.withColumns(_compiled({f"_z_{c}": s for c, s in scores.items()}, F.col("_k")))
    values = {}
    for c, grid in profile.grids.items():
        own = uniform("_k", f"draw:{c}")
        values[c] = _number_at(F.col(f"_z_{c}"), grid, max_score) if c in linked else _quantile(own, grid)
    values |= {c: iso_text(F.timestamp_seconds(F.round(values[c]))) for c in profile.times}
    for c, share in profile.shares.items():
        own = uniform("_k", f"draw:{c}")
        values[c] = _category_at(F.col(f"_z_{c}"), own, share, max_score) if c in linked else _category(own, share)
    values |= {c: F.col(f"_value_{c}") for c in profile.tables}
    for c, share in profile.nulls.items():
        if 0 < share:
            values[c] = F.when(uniform("_k", f"null:{c}") >= F.lit(share), values[c])
    values |= {c: _uuid(F.concat_ws(":", F.lit(seed), F.lit(c), F.col(key))) for c in profile.ids}
    values = _compiled({c: values[c] for c in profile.columns}, F.col("_k"))
    return rows.select(key, *[value.alias(c) for c, value in values.items()])


def learn_transactions(df: DataFrame) -> Profile:
    """All 14 columns of raw transactions."""
    special = {"transaction_id", "transaction_ts", "amount", "balance_after"}
    return learn(
        df,
        ["amount", "balance_after"],
        [c for c in RAW_COLUMNS if c not in special],
        times=["transaction_ts"],
        ids=["transaction_id"],
    )


def learned_transactions(ids: DataFrame, profile: Profile, key: str = "id", seed: int = 0) -> DataFrame:
    """One raw transaction per key, drawn from what ``learn_transactions`` found."""
    return sample(ids.select(F.col(key).alias("_key")), profile, "_key", seed).select(*RAW_COLUMNS)


def by_column(df: DataFrame, values: Mapping[str, Column], *others: Column) -> DataFrame:
    """A row for each column of a row: its ``place`` among ``values``, its ``value``, and the others.

    A place is a shorter key than a name, and an array costs a row less than a map, which looks
    for a name that comes twice.
    """
    return df.select(F.posexplode(F.array(*values.values())).alias("place", "value"), *others)


def column_at(place: str, columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col(place)).alias("column")


def _value_shares(df: DataFrame, columns: Sequence[str], most: int) -> tuple[dict, dict, dict]:
    """Shares of the values of each column: in a dictionary up to ``most`` values, else in a table.

    And in how many rows each column has a value.
    """
    if not columns:
        return {}, {}, {}
    folder = new_folder(df.sparkSession, "shares")
    (
        by_column(df, {c: F.col(c).cast("string") for c in columns})
        .where("value IS NOT NULL")
        .groupBy("place", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(column_at("place", columns), "value", "n")
        .write.parquet(f"{folder}/counts")
    )
    counts = df.sparkSession.read.parquet(f"{folder}/counts")
    sizes = {
        r["column"]: r
        for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total")).collect()
    }
    large = [c for c in columns if c in sizes and sizes[c]["values"] > most]
    found = counts.where(~F.col("column").isin(large)).collect()
    shares = {}
    for c in columns:
        if c not in large:
            own = sorted((-r["n"], r["value"]) for r in found if r["column"] == c)
            shares[c] = {value: -n / sizes[c]["total"] for n, value in own}
    totals = {c: sizes[c]["total"] if c in sizes else 0 for c in columns}
    return shares, _share_tables(counts, {c: sizes[c] for c in large}, f"{folder}/places"), totals


def _share_tables(counts: DataFrame, sizes: Mapping, path: str) -> dict[str, Shares]:
    """Number the rows of each column's values: sums over at most 4,096 groups, then within each."""
    if not sizes:
        return {}
    widths = {c: -(-size["total"] // size["values"]) for c, size in sizes.items()}
    own = counts.where(F.col("column").isin(list(sizes))).withColumn("group", F.substring(F.md5("value"), 1, 3))
    before = Window.unboundedPreceding
    by_group = Window.partitionBy("column").orderBy("group").rowsBetween(before, -1)
    ahead = own.groupBy("column", "group").agg(F.sum("n").alias("n")).select(
        "column", "group", F.coalesce(F.sum("n").over(by_group), F.lit(0)).alias("ahead")
    )
    within = Window.partitionBy("column", "group").orderBy("value").rowsBetween(before, 0)
    placed = own.withColumn("upto", F.sum("n").over(within)).join(ahead, ["column", "group"])
    width = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])[F.col("column")]
    placed = placed.select("column", "value", (F.col("ahead") + F.col("upto")).alias("end"), "n", width.alias("width"))
    first, cell = F.col("end") - F.col("n"), lambda at: F.floor(at / F.col("width"))
    cells = F.explode(F.sequence(cell(first), cell(F.col("end") - 1)))
    placed.select("column", cells.alias("cell"), first.alias("first"), "end", "value").write.parquet(path)
    written = counts.sparkSession.read.parquet(path)
    return {
        c: Shares(written.where(F.col("column") == c).drop("column"), size["total"], widths[c])
        for c, size in sizes.items()
    }


def _compiled(columns: Mapping[str, Column], by: Column) -> dict[str, Column]:
    """The columns, for a projection whose code is split into methods small enough to be compiled.

    Code of a whole stage puts all columns of a row into one method, and past 8,000 bytes of it the
    JVM interprets every row. A lambda (here one that is always true, over any column ``by`` of the
    rows) keeps a projection out of that, and so its code in parts, however many columns there are.
    """
    always = F.exists(F.array(by), lambda x: F.lit(True))
    return {c: F.when(always, column) if i == 0 else column for i, (c, column) in enumerate(columns.items())}


def score_correlation(df: DataFrame, profile: Profile, bins: int = SCORE_BINS) -> np.ndarray:
    """Correlations of a table's rows under the distributions of a profile, in the order of its columns."""
    numbers = [parse_ts(c) if c in profile.times else F.col(c) for c in profile.grids]
    values = [n.cast("double").alias(c) for n, c in zip(numbers, profile.grids)]
    return _score_correlation(df.select(*values, *[F.col(c).cast("string").alias(c) for c in profile.shares]), profile, bins)


def _score_correlation(df: DataFrame, profile: Profile, bins: int) -> np.ndarray:
    """Correlations of the normal scores.

    A missing value counts as a middling one (score 0); a constant column has no correlation. The
    scores of a category come from a broadcast of at most ``max_categories`` rows.
    """
    n = len(profile.correlated)
    if n < 2:
        return np.eye(n)
    scores = [_number_score(F.col(c), g, bins) for c, g in profile.grids.items()]
    for i, (c, share) in enumerate(profile.shares.items(), len(profile.grids)):
        middles = _middle_scores(share)
        if len(share) <= LISTED_VALUES:
            place = F.array_position(_texts(share), F.col(c)).cast("int") - 1
            # (No place is before the first one, where there is no number.)
            scores.append(F.get(_numbers(middles), place) if share else F.lit(0.0))
        else:
            rows = [{f"_v{i}": v, f"_z{i}": z} for v, z in zip(share, middles)]
            known = _literal_rows(df.sparkSession, rows, f"_v{i} string, _z{i} double")
            df = df.join(F.broadcast(known), F.col(c) == F.col(f"_v{i}"), "left")
            scores.append(F.col(f"_z{i}"))
    # A row of the matrix per score: the score times all scores of its row, summed.
    z = F.array(*[F.coalesce(s, F.lit(0.0)) for s in scores])
    z = df.select(_compiled({"z": z}, F.col(profile.correlated[0]))["z"].alias("z"))
    products = [F.sum(F.col("x") * F.get("z", F.lit(j))).alias(f"p{j}") for j in range(n)]
    # (The outer form, so that the array is not computed once more to see whether it is empty.)
    sums = z.select("z", F.posexplode_outer("z").alias("i", "x")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), *products
    )
    found = sorted(sums.collect())
    if not found:
        return np.eye(n)
    rows = found[0]["n"]
    mean = np.array([r["s"] for r in found]) / rows
    covariance = np.array([[r[f"p{j}"] for j in range(n)] for r in found]) / rows - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    scale = np.outer(spread, spread)
    out = np.divide(covariance, scale, out=np.zeros_like(covariance), where=scale > 1e-9)
    np.fill_diagonal(out, 1.0)
    return out


def _linked(profile: Profile) -> tuple[list[str], np.ndarray]:
    """The columns that correlate with another one, and a root of their correlations."""
    columns = profile.correlated
    if profile.correlation is None or not columns:
        return [], np.eye(0)
    off = np.abs(profile.correlation - np.eye(len(columns))) >= LEAST_CORRELATION
    at = np.flatnonzero(off.any(1))
    root = _root(_latent(profile)[np.ix_(at, at)])
    root[np.abs(root) < LEAST_CORRELATION / 2] = 0
    return [columns[i] for i in at], root / np.sqrt((root**2).sum(1, keepdims=True))


def _latent(profile: Profile) -> np.ndarray:
    """Correlations to draw with.

    A category's score stands for a whole stretch of the normal distribution, so categories correlate
    less than what they were cut from. Dividing by how well a column's scores follow the uncut
    ones gives back, to first order, the correlations that were measured.
    """
    follow = [1.0] * len(profile.grids) + [_following(share) for share in profile.shares.values()]
    out = np.clip(profile.correlation / np.outer(follow, follow), -1.0, 1.0)
    np.fill_diagonal(out, 1.0)
    return out


def _middle_scores(share: Mapping[str, float]) -> list[float]:
    """Normal score of each value: of the middle of its stretch of [0, 1]."""
    parts = np.array(list(share.values()))
    return [NORMAL.inv_cdf(min(max(float(m), 1e-12), 1 - 1e-12)) for m in np.cumsum(parts) - parts / 2]


def _following(share: Mapping[str, float]) -> float:
    """Correlation of a category's scores with the normal scores they are cut from."""
    parts, scores = np.array(list(share.values())), np.array(_middle_scores(share))
    spread = math.sqrt(max(float((parts * scores**2).sum() - (parts * scores).sum() ** 2), 0.0)) if len(parts) else 0.0
    if spread < 1e-9:
        return 1.0
    cuts = [NORMAL.inv_cdf(min(max(float(u), 1e-12), 1 - 1e-12)) for u in np.cumsum(parts)[:-1]]
    density = np.array([0.0, *[NORMAL.pdf(x) for x in cuts], 0.0])
    return min(1.0, max(0.1, float((scores * (density[:-1] - density[1:])).sum()) / spread))


def _root(correlation: np.ndarray) -> np.ndarray:
    """A root of the nearest matrix without negative eigenvalues, its diagonal brought back to one."""
    values, vectors = np.linalg.eigh(correlation)
    whole = (vectors * np.maximum(values, 1e-9)) @ vectors.T
    spread = np.sqrt(np.diag(whole))
    return np.linalg.cholesky(whole / np.outer(spread, spread) + 1e-12 * np.eye(len(whole)))


def _numbers(values: Sequence[float]) -> Column:
    """An array of numbers as one literal: one constant of the plan, however many numbers."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _texts(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _literal_rows(spark, rows: Sequence[Mapping], schema: str) -> DataFrame:
    """A few rows as one constant."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    return ", ".join(":".join(field.split()) for field in schema.split(","))


def _number_score(col: Column, grid: Sequence[float], bins: int) -> Column:
    """Normal score of a number: of the middle of its stretch of the distribution."""
    if not grid:
        return F.lit(None).cast("double")
    bounds = np.interp(np.arange(1, bins) / bins, np.linspace(0, 1, len(grid)), grid)
    leaves = [NORMAL.inv_cdf((i + 0.5) / bins) for i in range(bins)]
    return F.when(col.isNotNull(), by_bounds(col, bounds, leaves))


def _number_at(z: Column, grid: Sequence[float], max_score: float) -> Column:
    """The number with a given normal score, from a table over evenly spaced scores."""
    if not grid:
        return F.lit(None).cast("double")
    scores = np.linspace(-max_score, max_score, SCORE_STEPS + 1)
    shares = [NORMAL.cdf(float(x)) for x in scores]
    table = _numbers(np.interp(shares, np.linspace(0, 1, len(grid)), grid))
    at = (z + F.lit(max_score)) * F.lit(SCORE_STEPS / (2 * max_score))
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(SCORE_STEPS)))
    low = F.least(at.cast("int"), F.lit(SCORE_STEPS - 1))
    left, right = F.get(table, low), F.get(table, low + 1)
    return left + (right - left) * (at - low)


@dataclass(frozen=True)
class AliasCells:
    """Walker's cells for each stretch: stretch ``b`` has ``size[b]`` cells from ``first[b]`` on.

    A cell stands for its ``own`` value up to ``keep`` and for the ``other`` one above. All cells of a
    stretch are equally likely, so a draw reads one cell, however many values there are.
    """

    first: list[int]
    size: list[int]
    keep: list[float]
    own: list[str]
    other: list[str]


def alias_cells(share: Mapping[str, float], bins: int = CATEGORY_BINS) -> AliasCells:
    """Cells that give every value its share of each of ``bins`` equally likely stretches of [0, 1]."""
    parts = np.array(list(share.values()), float)
    upto = np.cumsum(parts) / parts.sum()
    upto[-1] = 1.0
    start, values = np.concatenate([[0.0], upto[:-1]]), list(share)
    out = AliasCells([], [], [], [], [])
    for b in range(bins):
        low, high = b / bins, (b + 1) / bins
        met = np.flatnonzero((upto > low) & (start < high))
        keep, other = _alias((np.minimum(upto[met], high) - np.maximum(start[met], low)).tolist())
        out.first.append(len(out.keep))
        out.size.append(len(met))
        out.keep.extend(keep)
        out.own.extend(values[i] for i in met)
        out.other.extend(values[met[i]] for i in other)
    return out


def _alias(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """For each place: up to where its cell is its own, and whose the rest is."""
    n, total = len(weights), math.fsum(weights)
    left = [w * n / total for w in weights]
    keep, other = [1.0] * n, list(range(n))
    small = [i for i, w in enumerate(left) if w < 1]
    large = [i for i, w in enumerate(left) if w >= 1]
    while small and large:
        low, high = small.pop(), large[-1]
        keep[low], other[low] = left[low], high
        left[high] -= 1 - left[low]
        if left[high] < 1:
            small.append(large.pop())
    return keep, other


def _category_at(z: Column, draw: Column, share: Mapping[str, float], max_score: float) -> Column:
    """A value of the stretch in which a normal score falls, by its share of that stretch."""
    if not share:
        return F.lit(None).cast("string")
    cells = alias_cells(share)
    stretch = F.least((_number_at(z, [0.0, 1.0], max_score) * len(cells.size)).cast("int"), F.lit(len(cells.size) - 1))
    size, first = (F.get(_numbers(x), stretch).cast("int") for x in (cells.size, cells.first))
    return _cell(draw * size, size, first, cells)


def _category(draw: Column, share: Mapping[str, float]) -> Column:
    """A value by its share, from an even draw."""
    if not share:
        return F.lit(None).cast("string")
    if len(share) == 1:
        return F.lit(next(iter(share)))
    cells = alias_cells(share, 1)
    return _cell(draw * len(cells.own), F.lit(len(cells.own)), F.lit(0), cells)


def _cell(place: Column, size: Column, first: Column, cells: AliasCells) -> Column:
    """The value at a place in a stretch: a cell, and a part of it that is its own or the other's."""
    inside = F.least(place.cast("int"), size - 1)
    cell = first + inside
    own = place - inside < F.get(_numbers(cells.keep), cell)
    return F.get(_texts([*cells.own, *cells.other]), F.when(own, cell).otherwise(cell + len(cells.own)))


def _quantile(draw: Column, grid: Sequence[float]) -> Column:
    """The number below which an even draw's share of the source lies."""
    if not grid:
        return F.lit(None).cast("double")
    table, at = _numbers(grid), draw * (len(grid) - 1)
    low = at.cast("int")
    left, right = F.get(table, low), F.get(table, F.least(low + 1, F.lit(len(grid) - 1)))
    return left + (right - left) * (at - low)


def _normal_draw(seed: Column, salt: str) -> Column:
    """Standard normal draw, from two even ones (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, salt + ":r")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, salt + ":a"))
