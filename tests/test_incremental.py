"""The report of several loads: equal to one over all rows, and only touched periods are written."""

from __future__ import annotations

import glob
import os
import random
from datetime import date
from decimal import Decimal

from frames import rows
from lakeworks.operators.report import gold_daily_report
from lakeworks.plans.incremental import UNDATED, IncrementalGold

SCHEMA = """transaction_id string, customer_id string, transaction_date date, merchant_category string, channel string,
currency string, amount decimal(18,2)"""


def silver(spark, count, days, seed):
    chance = random.Random(seed)
    some = lambda *values: chance.choice(values)
    return spark.createDataFrame(
        [
            (
                f"t{seed}-{i}",
                some("c1", "c2", "c3", None),
                some(*days),
                some("FUEL", "FOOD", None),
                some("ATM", "WEB"),
                "INR",
                some(None, Decimal(chance.randrange(-500, 100000)) / 100),
            )
            for i in range(count)
        ],
        SCHEMA,
    )


def files_of(root, period):
    return {(f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{root}/gold/period={period}/*.parquet")}


def test_loads_add_up_and_other_days_stay(spark, tmp_path):
    gold = IncrementalGold(str(tmp_path / "gold"))
    january, february, march = date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1)
    loads = [
        silver(spark, 300, [january, february], 1),
        silver(spark, 200, [march, None], 2),
        silver(spark, 100, [february, march], 3),
    ]
    assert gold.add(loads[0], "a") == ["2024-01-01", "2024-02-01"]
    first = files_of(gold.root, "2024-01-01")
    assert first
    assert gold.add(loads[1], "b") == ["2024-03-01", UNDATED]
    assert gold.add(loads[2], "c") == ["2024-02-01", "2024-03-01"]
    assert files_of(gold.root, "2024-01-01") == first
    whole = loads[0].unionAll(loads[1]).unionAll(loads[2])
    assert rows(gold.read(spark)) == rows(gold_daily_report(whole))


def test_a_load_that_comes_again_and_an_empty_one(spark, tmp_path):
    gold = IncrementalGold(str(tmp_path / "gold"), "month")
    load = silver(spark, 200, [date(2024, 1, 1), date(2024, 1, 9), date(2024, 2, 1)], 4)
    assert gold.add(load.limit(0), "none") == []
    assert gold.add(load, "a") == ["2024-01-01", "2024-02-01"]
    before = rows(gold.read(spark))
    assert gold.add(load, "a") == ["2024-01-01", "2024-02-01"]
    assert gold.add(load.limit(0), "b") == []
    assert rows(gold.read(spark)) == before == rows(gold_daily_report(load))
