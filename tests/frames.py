"""Literal frames for tests."""

from __future__ import annotations

from lakeworks.schemas import RAW

BASE = {
    "transaction_id": "t1",
    "account_id": "ACC1",
    "customer_id": "CUST1",
    "transaction_type": "UPI",
    "amount": 10.0,
    "currency": "INR",
    "merchant_name": "M",
    "merchant_category": "FUEL",
    "channel": "ATM",
    "transaction_ts": "2024-01-01T00:00:00",
    "branch_code": "BR1",
    "status": "SUCCESS",
    "balance_after": 5.0,
    "country_code": "IN",
}
TEXT = ", ".join(f"{c} string" for c in RAW.fieldNames())


def raw(spark, *rows):
    """Raw rows, each the base row with some columns changed."""
    return spark.createDataFrame([tuple((BASE | r)[c] for c in RAW.fieldNames()) for r in rows], RAW)


def raw_text(spark, *rows):
    """The same with every column as text, as a loosely typed source would have it."""
    values = [tuple((BASE | r)[c] for c in RAW.fieldNames()) for r in rows]
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in row) for row in values], TEXT)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
