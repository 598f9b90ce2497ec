"""Checks that a write must pass before its rows become visible."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.operators.quality import DataQualityError, Rule, judge, measures
from lakeworks.sources.scratch import new_folder


@dataclass(frozen=True)
class Gate:
    """Rules, minimum rows and minimum score of an output.

    By default every rule must pass; with ``min_score`` a share of them is enough.
    """

    rules: Sequence[Rule] = field(default_factory=tuple)
    min_rows: int = 0
    min_score: float = 1.0

    @property
    def observable(self) -> list[Rule]:
        return [r for r in self.rules if r.row_wise]

    @property
    def others(self) -> list[Rule]:
        return [r for r in self.rules if not r.row_wise]


@dataclass(frozen=True)
class WriteResult:
    """What a write did. ``rows`` were written, ``target_count`` read back from storage."""

    target: str
    rows: int
    target_count: int
    bytes_written: int
    duration_seconds: float
    quality_score: float = 1.0
    snapshot_id: int | None = None


def check(
    spark: SparkSession, target: str, gate: Gate, observed: dict[str, Any], staged: DataFrame
) -> float:
    """Judge a staged output; returns its score or raises ``DataQualityError``.

    Row-wise rules come from the metrics observed while writing. Rules that need all rows
    together (unique ids) read just their columns of the staged files.
    """
    results = []
    for rules, counts in (
        (gate.observable, _one_row(spark, observed, len(gate.observable))),
        (gate.others, staged.agg(*measures(gate.others)) if gate.others else None),
    ):
        if rules:
            results += judge(counts, rules, target).first()["rules"]
    score = sum(r["passed"] for r in results) / len(results) if results else 1.0
    errors = [f"{r['rule']}: {r['message']}" for r in results if not r["passed"]]
    if observed["row_count"] < gate.min_rows:
        raise DataQualityError(
            f"{target}: Output row count {observed['row_count']} below minimum {gate.min_rows}"
        )
    if score < gate.min_score:
        raise DataQualityError(f"{target}: quality score {score:.4f}; {'; '.join(errors)}")
    return score


def staged_and_checked(df: DataFrame, target: str, gate: Gate) -> tuple[DataFrame, float]:
    """The rows, and their score: written once to the shared folder and judged there, so what passed is what is used.

    Without anything to check the rows themselves, unwritten.
    """
    if not (gate.rules or gate.min_rows):
        return df, 1.0
    spark, path = df.sparkSession, new_folder(df.sparkSession, "audit")
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    counts = staged.agg(*measures(gate.observable)).first().asDict()
    return staged, check(spark, target, gate, counts, staged)


def _one_row(spark: SparkSession, observed: dict[str, Any], n_rules: int) -> DataFrame:
    names = ["row_count", *[f"bad_{i}" for i in range(n_rules)]]
    values = tuple(int(observed[n] or 0) for n in names)
    return spark.createDataFrame([values], ", ".join(f"{n} bigint" for n in names))


def observed_measures(gate: Gate) -> list:
    return measures(gate.observable)


def clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of one table partition brought together, for few and well-sized files.

    The rebalance hint lets AQE merge small shuffle partitions and split a large one, so a
    date that holds a third of all rows is written by many tasks.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
