"""Silver -> gold report, and the query people run on it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeworks.schemas import GOLD_COLUMNS, GOLD_KEYS


def gold_daily_report(silver: DataFrame) -> DataFrame:
    """Count, sum, mean and distinct customers per day, category, channel and currency.

    Spark first combines per (group, customer) before the shuffle and counts customers in a
    second step, so one group holding most rows is spread by customer.
    """
    return (
        silver.withColumnRenamed("transaction_date", "report_date")
        .groupBy(*GOLD_KEYS)
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("amount").try_cast("decimal(18,2)").alias("total_amount"),
            F.avg("amount").try_cast("decimal(18,2)").alias("avg_amount"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .select(*GOLD_COLUMNS)
    )


def recent_report(gold: DataFrame, as_of: date | Column | None = None, days: int = 7) -> DataFrame:
    """Report rows of the last days, largest total first.

    With a literal or ``current_date()`` bound the filter prunes the date partitions of a
    stored report table.
    """
    if as_of is None:
        as_of = F.current_date()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of)
    return (
        gold.where(F.col("report_date") >= F.date_sub(as_of, days))
        .select("report_date", "merchant_category", "channel", "transaction_count", "total_amount")
        .orderBy(F.desc("total_amount"), "report_date", "merchant_category", "channel")
    )
