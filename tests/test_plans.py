"""What the plans must look like for the queries to work at scale."""

from __future__ import annotations

import re
from datetime import date

import pytest
from frames import rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lakeworks.operators import cleanse, quality
from lakeworks.operators.dedup import dedup
from lakeworks.operators.report import gold_daily_report, recent_report
from lakeworks.operators.topk import latest_per_group
from lakeworks.plans.star import table, transactions
from lakeworks.sources.files import file_inventory
from lakeworks.sources.scratch import new_folder
from lakeworks.sources.snapshots import SnapshotTable

SF_DIR = "/root/testdata/sf0.001"
WRITERS = {
    "scan_formats",
    "synthetic_learned",
    "ingest_json",
    "medallion_report",
    "migrate_dataset",
    "migrate_batched",
    "copy_deduplicated",
    "compacted_table",
    "sorted_table",
    "zorder_table",
    "orphans_of_a_crash",
    "stream_append",
    "stream_silver",
    "hybrid_append",
    "generated_json_lines",
    "synthetic_learned",
    "synthetic_learned_fit",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def silver(spark):
    t = SnapshotTable(new_folder(spark, "plans"), ("transaction_date",))
    t.write(cleanse.bronze_to_silver(transactions(spark, SF_DIR).where("transaction_ts < '1995-03-01'")))
    assert t.read(spark).count() > 0
    return t


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - WRITERS))
def test_no_python_rows_and_no_cross_joins(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for node in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "NestedLoopJoin", "Scan ExistingRDD"):
        assert node not in text, node


def test_dedup_and_top_k_cut_each_key_before_the_shuffle(spark):
    tx = transactions(spark, SF_DIR)
    for df in (
        dedup(tx, ["transaction_id"]),
        latest_per_group(table(spark, SF_DIR, "events"), ["event_type"], 5, ["ts"]),
    ):
        text = plan(df)
        final, exchange, partial = (text.index(s) for s in ("Final", "Exchange hashpartitioning", "Partial"))
        assert final < exchange < partial and text.count("WindowGroupLimit") == 2


def test_a_suite_scans_once(spark):
    orders = table(spark, SF_DIR, "orders")
    rules = [quality.not_null(c) for c in orders.columns]
    rules += [quality.positive_amount("o_totalprice"), quality.unique_id("o_orderkey")]
    assert plan(quality.quality_report(orders, rules)).count("FileScan") == 1


def test_status_filter_reaches_the_scan(spark):
    stored = table(spark, SF_DIR, "orders").withColumnRenamed("o_orderstatus", "status")
    assert "EqualTo(o_orderstatus,SUCCESS)" in plan(cleanse.successful(stored))


def test_report_reads_only_its_columns(spark, silver):
    schema = re.search(r"ReadSchema: struct<([^\n]*)", plan(gold_daily_report(silver.read(spark)))).group(1)
    assert "branch_code" not in schema and "balance_after" not in schema


def test_recent_report_prunes_partitions(spark):
    t = SnapshotTable(new_folder(spark, "gold"), ("report_date",))
    days = spark.range(20).select(F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("report_date"))
    for c in ("merchant_category", "channel", "currency"):
        days = days.withColumn(c, F.lit("x"))
    t.write(days.withColumn("transaction_count", F.lit(1)).withColumn("total_amount", F.lit(1.0)))
    recent = recent_report(t.read(spark), date(2024, 1, 20))
    assert "PartitionFilters: [isnotnull(report_date" in plan(recent)
    assert len(rows(recent)) == 8


def test_listing_never_reads_content(spark):
    text = plan(file_inventory(spark, {"orders": f"{SF_DIR}/orders.parquet"}))
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in text


def test_unused_dimensions_are_not_joined(spark):
    assert "Join" not in plan(transactions(spark, SF_DIR, ["transaction_id", "amount"]))
    assert plan(transactions(spark, SF_DIR, ["amount", "status"])).count("Join") == 1


def test_a_key_with_a_third_of_all_rows(spark):
    n = 60000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"),
        (F.col("id") * 7919 % n).alias("v"),
    )
    got = dedup(df, ["k"], ["v"])
    assert got.count() == n - n // 3 + 1
    assert got.where("k IS NULL").first()["v"] == df.where("k IS NULL").agg(F.max("v")).first()[0]


def test_a_report_group_with_a_third_of_all_rows(spark):
    n = 30000
    hot = F.col("id") % 3 == 0
    silver = spark.range(n).select(
        F.lit(date(2024, 1, 1)).alias("transaction_date"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("merchant_category"),
        F.lit("ATM").alias("channel"),
        F.lit("INR").alias("currency"),
        F.lit(1).cast("decimal(18,2)").alias("amount"),
        (F.col("id") % 7000).cast("string").alias("customer_id"),
    )
    report = gold_daily_report(silver)
    got = report.where("merchant_category = 'hot'").first()
    assert (got["transaction_count"], got["total_amount"]) == (n // 3, n // 3)
    assert got["unique_customers"] == silver.where("merchant_category = 'hot'").select("customer_id").distinct().count()
    # Customers are counted in a step of their own, spread by group and customer.
    assert re.search(r"Exchange hashpartitioning\([^)]*customer_id", plan(report))
