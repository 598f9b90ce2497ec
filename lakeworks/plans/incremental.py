"""The gold report kept up to date load by load, without reading the whole silver table again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.schemas import GOLD_COLUMNS, GOLD_KEYS

#: What can be added up over loads: one row per group and customer.
PARTIAL_SCHEMA = """report_date date, merchant_category string, channel string, currency string, customer_id string,
transactions long, amounts long, amount decimal(38,2), load string, period string"""
GOLD_SCHEMA = """report_date date, merchant_category string, channel string, currency string, transaction_count long,
total_amount decimal(18,2), avg_amount decimal(18,2), unique_customers long, period string"""
UNDATED = "undated"


@dataclass(frozen=True)
class IncrementalGold:
    """A gold table below ``root``, and the partials it is made of, both in partitions by period.

    A load writes its own partials and then the periods it has rows of, from the partials of all
    loads; other periods are neither read nor written. ``period`` is a unit of dates (``day``,
    ``month``, ...). A load that is added again, after a failure or by mistake, replaces itself, so
    nothing counts twice; it has to bring the same rows. One load runs at a time.

    ::

        root/partials/load=<id>/period=<first day>/
        root/gold/period=<first day>/
    """

    root: str
    period: str = "day"

    def add(self, silver: DataFrame, load: str) -> list[str]:
        """Take in the silver rows of one load; returns the periods written anew.

        An empty load changes nothing. Rows without a date are a period of their own.
        """
        spark = silver.sparkSession
        own = f"{self.root}/partials/load={load}"
        partials = _partials(silver).withColumn("period", self._period())
        partials.hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(own)
        everything = spark.read.schema(PARTIAL_SCHEMA).parquet(f"{self.root}/partials")
        # At most as many as a load has days; literals, so that only these partitions are listed and read.
        touched = sorted(r["period"] for r in everything.where(F.col("load") == load).select("period").distinct().collect())
        if touched:
            gold = _report(everything.where(F.col("period").isin(touched))).withColumn("period", self._period())
            gold.hint("rebalance", "period").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("period").parquet(f"{self.root}/gold")
        return touched

    def read(self, spark: SparkSession) -> DataFrame:
        """The report of all loads so far."""
        return spark.read.schema(GOLD_SCHEMA).parquet(f"{self.root}/gold").select(*GOLD_COLUMNS)

    def _period(self) -> Column:
        first = F.date_format(F.date_trunc(self.period, "report_date"), "yyyy-MM-dd")
        return F.coalesce(first, F.lit(UNDATED))


def _partials(silver: DataFrame) -> DataFrame:
    """Counts and sums per group and customer; combined in each task before the shuffle."""
    return (
        silver.withColumnRenamed("transaction_date", "report_date")
        .groupBy(*GOLD_KEYS, "customer_id")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.count("amount").alias("amounts"),
            F.sum("amount").cast("decimal(38,2)").alias("amount"),
        )
    )


def _report(partials: DataFrame) -> DataFrame:
    """Partials of any number of loads as report rows: a customer of several loads counts once."""
    return (
        partials.groupBy(*GOLD_KEYS, "customer_id")
        .agg(*[F.sum(c).alias(c) for c in ("transactions", "amounts", "amount")])
        .groupBy(*GOLD_KEYS)
        .agg(
            F.sum("transactions").alias("transaction_count"),
            F.sum("amount").try_cast("decimal(18,2)").alias("total_amount"),
            F.try_divide(F.sum("amount"), F.sum("amounts").cast("decimal(19,0)")).try_cast("decimal(18,2)").alias("avg_amount"),
            F.count("customer_id").alias("unique_customers"),
        )
    )
