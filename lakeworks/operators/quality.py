"""Data-quality rules, compiled together into one aggregate over the data.

Every rule counts its violations. All counts of a suite are taken in a single ``agg``, so a
suite of any length reads its table once, and only one small row per task is shuffled.
(A uniqueness rule adds a shuffle of the distinct ids, combined per task first.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeworks.schemas import TableStandard


class DataQualityError(RuntimeError):
    """Input or output of a governed step does not meet its rules."""


@dataclass(frozen=True)
class Rule:
    """One check: how to count violations, how many are tolerated, what to say.

    ``violations`` is an aggregate column; ``message`` gets the violation and row counts.
    ``row_wise`` tells that the count is a plain sum over rows, so that it can be observed
    while the rows are being written.
    """

    name: str
    violations: Column
    message: Callable[[Column, Column], Column]
    max_ratio: float = 0.0
    row_wise: bool = True


def not_null(column: str, max_null_ratio: float = 0.0, name: str | None = None) -> Rule:
    """Share of nulls in a column; an empty table has ratio 0 and passes."""
    return Rule(
        name or f"{column}_not_null",
        F.count_if(F.col(column).isNull()),
        lambda bad, total: F.format_string(f"{column} null ratio %.4f", _ratio(bad, total)),
        max_null_ratio,
    )


def positive_amount(column: str = "amount", name: str | None = None) -> Rule:
    """No value at or below zero. A null is not a violation."""
    return Rule(
        name or f"{column}_positive",
        F.count_if(F.col(column) <= 0),
        lambda bad, total: F.format_string(f"%d non-positive {column} rows", bad),
    )


def allowed_values(column: str, values: Iterable, name: str | None = None) -> Rule:
    """Only the given values; a null is a violation.

    The message counts rows. The offending values themselves may be as many as the rows, so
    they are a table of their own: ``disallowed_values``.
    """
    return Rule(
        name or f"{column}_allowed",
        F.count_if(not_allowed(column, values)),
        lambda bad, total: F.format_string(f"%d rows with invalid {column} values", bad),
    )


def balance_check(
    amount: str = "amount", balance: str = "balance_after", name: str = "balance_check"
) -> Rule:
    """No negative amount or balance. Zero and null pass."""
    return Rule(
        name,
        F.count_if((F.col(amount) < 0) | (F.col(balance) < 0)),
        lambda bad, total: F.format_string("%d rows with negative amount/balance", bad),
    )


def unique_id(column: str = "transaction_id", name: str = "transaction_consistency") -> Rule:
    """As many distinct ids as rows; all null ids together count as one id."""
    has_null = F.coalesce(F.max(F.col(column).isNull().cast("long")), F.lit(0))
    return Rule(
        name,
        F.count(F.lit(1)) - F.count_distinct(F.col(column)) - has_null,
        lambda bad, total: F.format_string("total=%d distinct=%d", total, total - bad),
        row_wise=False,
    )


def required_column(df: DataFrame, column: str) -> Rule:
    """The column exists; decided from the schema alone."""
    missing = column not in df.columns
    return Rule(
        f"{column}_required",
        F.lit(int(missing)).cast("long"),
        lambda bad, total: F.lit(f"{column} {'missing' if missing else 'present'}"),
        max_ratio=-1.0 if missing else 0.0,
    )


RULE_TYPES: dict[str, Callable[..., Rule]] = {
    "not_null": not_null,
    "positive_amount": positive_amount,
    "allowed_values": allowed_values,
    "balance_check": balance_check,
    "unique_id": unique_id,
}


def rule(name: str, rule_type: str, **config) -> Rule:
    """A rule from its configuration. An unknown type is an error, not a pass."""
    if rule_type not in RULE_TYPES:
        raise ValueError(f"unknown rule type {rule_type!r}; known: {sorted(RULE_TYPES)}")
    return RULE_TYPES[rule_type](name=name, **config)


def business_rules(id_column: str = "transaction_id") -> list[Rule]:
    """The two rules of the domain, in order: balances, then ids."""
    return [balance_check(), unique_id(id_column)]


def standard_rules(df: DataFrame, standard: TableStandard) -> list[Rule]:
    """A declared table standard as rules: required columns, then null thresholds."""
    present = [c for c in standard.null_thresholds if c in df.columns]
    return [
        *[required_column(df, c) for c in standard.columns],
        *[not_null(c, standard.null_thresholds[c]) for c in present],
    ]


def not_allowed(column: str, values: Iterable) -> Column:
    col = F.col(column)
    return col.isNull() | ~col.isin([v for v in values if v is not None])


def disallowed_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Distinct values of a column outside the allowed list, null included; any number."""
    return df.where(not_allowed(column, values)).select(F.col(column).alias("value")).distinct()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = missing_columns(df, required)
    if missing:
        raise DataQualityError(f"Missing columns: {missing}")
    return df


def measures(rules: Sequence[Rule]) -> list[Column]:
    """The aggregates a suite needs: the row count and one violation count per rule."""
    counts = [r.violations.cast("long").alias(f"bad_{i}") for i, r in enumerate(rules)]
    return [F.count(F.lit(1)).alias("row_count"), *counts]


def judge(counts: DataFrame, rules: Sequence[Rule], table_name: str) -> DataFrame:
    """Turn one row of measures into one quality record.

    Columns: table_name, row_count, quality_score, passed, rules (array of name, violations,
    ratio, passed, message). The score is the share of rules that passed; with no rules
    nothing failed, so it is 1.
    """
    total = F.col("row_count")
    results = []
    for i, r in enumerate(rules):
        bad = F.col(f"bad_{i}")
        ratio = _ratio(bad, total)
        results.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                bad.alias("violations"),
                ratio.alias("ratio"),
                (ratio <= F.lit(r.max_ratio)).alias("passed"),
                r.message(bad, total).alias("message"),
            )
        )
    if not results:
        empty = "array<struct<rule:string,violations:bigint,ratio:double,passed:boolean,message:string>>"
        verdicts = F.from_json(F.lit("[]"), empty)
    else:
        verdicts = F.array(*results)
    n_passed = F.size(F.filter("rules", lambda r: r["passed"]))
    return counts.select(F.lit(table_name).alias("table_name"), "row_count", verdicts.alias("rules")).select(
        "table_name",
        "row_count",
        (n_passed / F.lit(float(len(rules))) if rules else F.lit(1.0)).alias("quality_score"),
        (n_passed == F.lit(len(rules))).alias("passed"),
        "rules",
    )


def quality_record(df: DataFrame, rules: Sequence[Rule], table_name: str = "") -> DataFrame:
    """Run a suite: one row with score, verdict and all rule results."""
    return judge(df.agg(*measures(rules)), rules, table_name)


def quality_report(df: DataFrame, rules: Sequence[Rule], table_name: str = "") -> DataFrame:
    """Run a suite: one row per rule, with the score of the whole suite."""
    return (
        quality_record(df, rules, table_name)
        .select("table_name", "row_count", "quality_score", F.explode("rules").alias("r"))
        .select("table_name", "row_count", "quality_score", "r.*")
    )


def _ratio(bad: Column, total: Column) -> Column:
    return bad / F.greatest(total, F.lit(1))
