"""The star-schema tables seen as raw transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeworks.schemas import RAW_COLUMNS

_FROM_ORDERS = {"account_id", "transaction_type", "status"}
_FROM_CUSTOMER = {"customer_id", "channel", "balance_after"}
_FROM_NATION = {"branch_code", "country_code"}
_FROM_SUPPLIER = {"merchant_name"}
_FROM_PART = {"merchant_category"}

_EXPRESSIONS = {
    "transaction_id": "concat(l_orderkey, '-', l_linenumber)",
    "account_id": "concat('ACC', o_custkey)",
    "customer_id": "concat('CUST', c_custkey)",
    "transaction_type": "o_orderpriority",
    "amount": "l_extendedprice",
    "currency": "'INR'",
    "merchant_name": "s_name",
    "merchant_category": "p_type",
    "channel": "c_mktsegment",
    "transaction_ts": "cast(l_shipdate AS timestamp)",
    "branch_code": "concat('BR', n_nationkey)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END",
    "balance_after": "c_acctbal",
    "country_code": "n_name",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] = tuple(RAW_COLUMNS)
) -> DataFrame:
    """One raw transaction per line item.

    Dimensions none of whose columns is asked for are not joined at all: their keys are
    foreign keys, so such a join would neither drop nor repeat a line item. Join sides and
    strategies are left to Catalyst and AQE (skew join included).
    """
    wanted = set(columns)
    tx = table(spark, sf_dir, "lineitem")
    # Line items are the widest shuffle: they meet the small sides first, while they are narrow, and
    # the orders once, which bring all that is joined by way of them.
    if wanted & _FROM_PART:
        tx = tx.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
    if wanted & _FROM_SUPPLIER:
        tx = tx.join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    if wanted & (_FROM_ORDERS | _FROM_CUSTOMER | _FROM_NATION):
        orders = table(spark, sf_dir, "orders")
        if wanted & (_FROM_CUSTOMER | _FROM_NATION):
            customers = table(spark, sf_dir, "customer")
            if wanted & _FROM_NATION:
                customers = customers.join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
            orders = orders.join(customers, F.expr("o_custkey = c_custkey"))
        tx = tx.join(orders, F.expr("l_orderkey = o_orderkey"))
    return tx.select(*[F.expr(_EXPRESSIONS[c]).alias(c) for c in columns])
