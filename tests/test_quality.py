from __future__ import annotations

import pytest
from frames import raw, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeworks.operators import quality as q
from lakeworks.operators.profile import profile_nulls, row_count, schema_findings
from lakeworks.schemas import SILVER_STANDARD, TableStandard

SCHEMA = "transaction_id string, amount double, balance_after double, status string"


def results(df, rules):
    return {r["rule"]: (r["violations"], r["passed"], r["message"]) for r in q.quality_report(df, rules).collect()}


def suite():
    return [
        q.not_null("amount"),
        q.not_null("amount", 0.5, "lenient"),
        q.positive_amount(),
        q.allowed_values("status", ["A", "B"]),
        *q.business_rules(),
    ]


def test_empty_table_passes_everything(spark):
    record = q.quality_record(spark.createDataFrame([], SCHEMA), suite(), "t").first()
    assert (record["table_name"], record["row_count"], record["quality_score"], record["passed"]) == ("t", 0, 1.0, True)
    assert len(record["rules"]) == 6


def test_empty_suite_scores_one(spark):
    record = q.quality_record(spark.createDataFrame([("a", 1.0, 1.0, "A")], SCHEMA), []).first()
    assert (record["row_count"], record["quality_score"], record["passed"], record["rules"]) == (1, 1.0, True, [])


def test_null_logic_differs_per_rule(spark):
    got = results(spark.createDataFrame([("a", None, None, None), ("b", 0.0, 0.0, "A")], SCHEMA), suite())
    assert got["amount_not_null"] == (1, False, "amount null ratio 0.5000")
    assert got["lenient"] == (1, True, "amount null ratio 0.5000")
    assert got["amount_positive"] == (1, False, "1 non-positive amount rows")
    assert got["status_allowed"][:2] == (1, False)
    assert got["balance_check"] == (0, True, "0 rows with negative amount/balance")
    assert got["transaction_consistency"] == (0, True, "total=2 distinct=2")


def test_negative_balance_with_null_amount_is_a_violation(spark):
    got = results(spark.createDataFrame([("a", None, -0.01, "A")], SCHEMA), [q.balance_check()])
    assert got["balance_check"][:2] == (1, False)


def test_unknown_rule_type_raises():
    with pytest.raises(ValueError, match="unknown rule type"):
        q.rule("x", "no_such_rule")


value = st.one_of(st.none(), st.sampled_from([-1.0, 0.0, 1.0]))
table = st.lists(
    st.tuples(st.one_of(st.none(), st.sampled_from("xyz")), value, value, st.one_of(st.none(), st.sampled_from("ABC"))),
    max_size=20,
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(table)
def test_suite_agrees_with_a_plain_model(spark, data):
    nulls = sum(r[1] is None for r in data)
    ratio = nulls / max(len(data), 1)
    bad = sum(r[1] is not None and r[1] <= 0 for r in data)
    unknown = sum(r[3] not in ("A", "B") for r in data)
    negative = sum((r[1] or 0) < 0 or (r[2] or 0) < 0 for r in data)
    distinct = len({r[0] for r in data})
    expected = {
        "amount_not_null": (nulls, ratio <= 0),
        "lenient": (nulls, ratio <= 0.5),
        "amount_positive": (bad, bad == 0),
        "status_allowed": (unknown, unknown == 0),
        "balance_check": (negative, negative == 0),
        "transaction_consistency": (len(data) - distinct, len(data) == distinct),
    }
    record = q.quality_record(spark.createDataFrame(data, SCHEMA), suite()).first()
    assert {r["rule"]: (r["violations"], r["passed"]) for r in record["rules"]} == expected
    passed = sum(p for _, p in expected.values())
    assert record["quality_score"] == pytest.approx(passed / 6)
    assert record["passed"] == (passed == 6)


def test_disallowed_values_lists_null_once(spark):
    df = spark.createDataFrame([("A",), ("C",), ("C",), (None,), (None,)], "s string")
    assert rows(q.disallowed_values(df, "s", ["A"])) == [("C",), (None,)]
    assert rows(q.disallowed_values(df, "s", ["A", None])) == [("C",), (None,)]


def test_required_columns(spark):
    df = raw(spark, {})
    assert q.require_columns(df, ["amount"]) is df
    with pytest.raises(q.DataQualityError, match="nope"):
        q.require_columns(df, ["amount", "nope"])


def test_table_standard(spark):
    df = raw(spark, {}, {"amount": None}).drop("channel")
    got = results(df, q.standard_rules(df, SILVER_STANDARD))
    assert got["channel_required"] == (1, False, "channel missing")
    assert got["currency_required"][:2] == (0, True)
    assert got["amount_not_null"][:2] == (1, False)
    empty = TableStandard("t", {"nope": "string"})
    assert results(df.limit(0), q.standard_rules(df, empty))["nope_required"][:2] == (1, False)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert rows(profile_nulls(df)) == [("a", 1, 2, 2), ("b", 2, 2, 2)]
    assert rows(row_count(df)) == [(2,)]


def test_schema_findings(spark):
    df = spark.createDataFrame([("1", "x"), ("bad", None)], "a string, extra string")
    got = rows(schema_findings(df, {"a": "int", "gone": "string"}))
    assert got == [
        ("a", "type_mismatch", 1, True),
        ("extra", "extra", 1, True),
        ("gone", "missing", 2, False),
    ]
    assert rows(schema_findings(df, {"a": "string", "extra": "string"})) == []
