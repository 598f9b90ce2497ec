"""Column lists and schemas of the raw, cleansed and report layers, and of the run logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

RAW = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("merchant_name", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("transaction_ts", T.StringType()),
        T.StructField("branch_code", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("balance_after", T.DoubleType()),
        T.StructField("country_code", T.StringType()),
    ]
)
RAW_COLUMNS = RAW.fieldNames()

SILVER_COLUMNS = [
    *RAW_COLUMNS[: RAW_COLUMNS.index("transaction_ts") + 1],
    "transaction_date",
    *RAW_COLUMNS[RAW_COLUMNS.index("transaction_ts") + 1 :],
]

GOLD_KEYS = ["report_date", "merchant_category", "channel", "currency"]
GOLD_COLUMNS = [*GOLD_KEYS, "transaction_count", "total_amount", "avg_amount", "unique_customers"]

RUNS = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("sla_name", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("output_count", T.LongType()),
        T.StructField("target_count", T.LongType()),
        T.StructField("bytes_processed", T.LongType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

QUALITY_LOG = T.StructType(
    [
        T.StructField("sla_name", T.StringType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

BATCH_LOG = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("bytes_processed", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class TableStandard:
    """Columns a table must have, their types, and the null ratio each may show."""

    name: str
    columns: dict[str, str]
    null_thresholds: dict[str, float] = field(default_factory=dict)


# The declared standard of the transaction tables.
TRANSACTION_TYPES = {
    "transaction_id": "string",
    "account_id": "string",
    "customer_id": "string",
    "transaction_type": "string",
    "amount": "decimal(18,2)",
    "currency": "string",
    "merchant_category": "string",
    "channel": "string",
    "transaction_ts": "timestamp",
    "status": "string",
}
NULL_THRESHOLDS = {
    "transaction_id": 0.0,
    "account_id": 0.0,
    "amount": 0.01,
    "transaction_ts": 0.01,
}

BRONZE_STANDARD = TableStandard("bronze_transactions", TRANSACTION_TYPES, NULL_THRESHOLDS)
SILVER_STANDARD = TableStandard(
    "silver_transactions", {**TRANSACTION_TYPES, "transaction_date": "date"}, NULL_THRESHOLDS
)


@dataclass(frozen=True)
class Sla:
    """Limits of one class of runs."""

    name: str
    max_execution_seconds: int
    min_success_rate: float
    alert_threshold: float = 0.8


# Run-time limits per class of runs.
SLAS = (
    Sla("critical_etl", 1800, 0.995),
    Sla("batch_migration", 14400, 0.99),
    Sla("analytical_workload", 7200, 0.98),
)
