"""Raw -> bronze -> silver."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeworks.functions.columns import iso_text, money, parse_date, parse_ts
from lakeworks.operators.dedup import dedup
from lakeworks.schemas import SILVER_COLUMNS

NEWEST_FIRST = ["transaction_ts", "amount", "merchant_name", "merchant_category"]


def normalize_raw(df: DataFrame) -> DataFrame:
    """Bring a raw batch to its text form: string ids, ISO timestamps, money to two places."""
    return df.withColumns(
        {
            "transaction_id": F.col("transaction_id").cast("string"),
            "transaction_ts": iso_text(parse_ts("transaction_ts")),
            "amount": F.round("amount", 2),
            "balance_after": F.round("balance_after", 2),
        }
    )


def bronze_enrich(
    df: DataFrame, source_path: str, ingest_ts: datetime | Column | None = None
) -> DataFrame:
    """Add ingest time, source path and partition date to raw rows.

    Pass ``ingest_ts`` where a replay must give the same rows; it defaults to now.
    """
    if ingest_ts is None:
        ingest_ts = F.current_timestamp()
    elif not isinstance(ingest_ts, Column):
        ingest_ts = F.lit(ingest_ts)
    return df.withColumns(
        {
            "ingest_ts": ingest_ts,
            "source_path": F.lit(source_path),
            "transaction_date": parse_date("transaction_ts"),
        }
    )


def typed(df: DataFrame) -> DataFrame:
    """Parse the timestamp, derive the date, cast the money columns."""
    return df.withColumns(
        {
            "transaction_ts": parse_ts("transaction_ts"),
            "transaction_date": parse_date("transaction_ts"),
            "amount": money("amount"),
            "balance_after": money("balance_after"),
        }
    )


def successful(df: DataFrame) -> DataFrame:
    """Settled rows only; a null status is dropped."""
    return df.where(F.col("status") == "SUCCESS")


def positive(df: DataFrame) -> DataFrame:
    """Rows with an amount above zero. Apply after the cast: 0.004 is 0.00 there."""
    return df.where(F.col("amount") > 0)


def valid_rows(df: DataFrame) -> DataFrame:
    """Typed silver candidates: everything but the deduplication."""
    return df.transform(typed).transform(successful).transform(positive).select(*SILVER_COLUMNS)


def bronze_to_silver(df: DataFrame) -> DataFrame:
    """Typed, filtered, one row per transaction id (the newest)."""
    return dedup(valid_rows(df), ["transaction_id"], NEWEST_FIRST)
