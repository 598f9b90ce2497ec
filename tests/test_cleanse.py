from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from frames import raw, raw_text, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeworks.functions.columns import parse_ts
from lakeworks.operators import cleanse
from lakeworks.operators.dedup import dedup
from lakeworks.operators.report import gold_daily_report, recent_report
from lakeworks.schemas import GOLD_COLUMNS, SILVER_COLUMNS


def test_status_null_and_case(spark):
    statuses = ["SUCCESS", "FAILED", "PENDING", None, "success"]
    df = raw(spark, *[{"transaction_id": str(i), "status": s} for i, s in enumerate(statuses)])
    assert rows(cleanse.bronze_to_silver(df), "transaction_id") == [("0",)]


def test_amount_is_filtered_after_the_cast(spark):
    amounts = ["1.005", "0.004", "0", "-1", None, "bad", "1e20"]
    df = raw_text(spark, *[{"transaction_id": str(i), "amount": a} for i, a in enumerate(amounts)])
    assert rows(cleanse.bronze_to_silver(df), "transaction_id", "amount") == [("0", Decimal("1.01"))]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_timestamps_become_null(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        texts = ["2024-01-01T00:00:00", "2024-01-01T10:00:00.123Z", "nope", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(parse_ts("t")).collect()]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got == [datetime(2024, 1, 1), datetime(2024, 1, 1, 10, 0, 0, 123000), None, None]


def test_silver_columns_and_types(spark):
    silver = cleanse.bronze_to_silver(raw(spark, {}))
    assert silver.columns == SILVER_COLUMNS and len(SILVER_COLUMNS) == 15
    types = dict(silver.dtypes)
    assert types["amount"] == types["balance_after"] == "decimal(18,2)"
    assert (types["transaction_ts"], types["transaction_date"]) == ("timestamp", "date")


def test_duplicates(spark):
    df = raw(
        spark,
        {"transaction_id": "a", "transaction_ts": "2024-01-01T00:00:00", "amount": 1.0},
        {"transaction_id": "a", "transaction_ts": "2024-01-02T00:00:00", "amount": 2.0},
        {"transaction_id": "b"},
        {"transaction_id": "b"},
        {"transaction_id": None},
        {"transaction_id": None},
    )
    got = rows(cleanse.bronze_to_silver(df), "transaction_id", "amount")
    assert got == [("a", Decimal("2.00")), ("b", Decimal("10.00")), (None, Decimal("10.00"))]


def test_filter_comes_before_dedup(spark):
    df = raw(
        spark,
        {"transaction_ts": "2024-01-02T00:00:00", "status": "FAILED"},
        {"transaction_ts": "2024-01-01T00:00:00", "amount": 3.0},
    )
    assert rows(cleanse.bronze_to_silver(df), "amount", "status") == [(Decimal("3.00"), "SUCCESS")]


def test_bronze_enrich(spark):
    at = datetime(2024, 5, 1, 12)
    got = cleanse.bronze_enrich(raw(spark, {}, {"transaction_ts": "nope"}), "p", at)
    assert got.columns[-3:] == ["ingest_ts", "source_path", "transaction_date"]
    assert rows(got, "ingest_ts", "source_path", "transaction_date") == [
        (at, "p", None),
        (at, "p", date(2024, 1, 1)),
    ]
    assert cleanse.bronze_enrich(raw(spark, {}), "p").first()["ingest_ts"] is not None


def test_normalize_raw(spark):
    df = spark.createDataFrame(
        [(7, datetime(2024, 1, 1, 1, 2, 3, 9000), 1.239, 2.0)],
        "transaction_id long, transaction_ts timestamp, amount double, balance_after double",
    )
    assert rows(cleanse.normalize_raw(df)) == [("7", "2024-01-01T01:02:03", 1.24, 2.0)]


keyed = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 4)), st.text("ab", max_size=2)
    ),
    max_size=30,
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keyed, st.integers(1, 4))
def test_dedup_keeps_the_greatest_row_of_each_key(spark, data, parts):
    df = spark.createDataFrame(data, "k int, v int, s string").repartition(parts)
    got = rows(dedup(df, ["k"], ["v"]))
    newest = {}
    for row in data:
        rank = (row[1] is not None, row[1] or 0, row[2])
        if row[0] not in newest or rank > newest[row[0]][0]:
            newest[row[0]] = (rank, row)
    assert got == sorted((row for _, row in newest.values()), key=repr)


def test_dedup_without_keys_or_other_columns(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert dedup(df, []) is df
    assert rows(dedup(df, ["k"])) == [(1,), (2,)]


def test_gold_nulls_and_rounding(spark):
    silver = cleanse.bronze_to_silver(
        raw(
            spark,
            {"transaction_id": "1", "merchant_category": None, "amount": 0.01},
            {"transaction_id": "2", "merchant_category": None, "amount": 0.02, "customer_id": None},
            {"transaction_id": "3", "merchant_category": None, "amount": 0.02},
            {"transaction_id": "4", "amount": 1.0},
        )
    )
    gold = gold_daily_report(silver)
    assert gold.columns == GOLD_COLUMNS
    day = date(2024, 1, 1)
    assert rows(gold) == [
        (day, "FUEL", "ATM", "INR", 1, Decimal("1.00"), Decimal("1.00"), 1),
        (day, None, "ATM", "INR", 3, Decimal("0.05"), Decimal("0.02"), 1),
    ]


def test_recent_report_is_ordered_and_bounded(spark):
    days = [("2024-01-01", 9), ("2024-01-02", 3), ("2024-01-09", 5)]
    gold = spark.createDataFrame(
        [(date.fromisoformat(d), "c", "ch", "INR", 1, Decimal(n), Decimal(n), 1) for d, n in days],
        "report_date date, merchant_category string, channel string, currency string, transaction_count long,"
        "total_amount decimal(18,2), avg_amount decimal(18,2), unique_customers long",
    )
    got = [tuple(r) for r in recent_report(gold, date(2024, 1, 9)).collect()]
    assert [(str(r[0]), int(r[4])) for r in got] == [("2024-01-09", 5), ("2024-01-02", 3)]
    assert recent_report(gold).count() == 0
