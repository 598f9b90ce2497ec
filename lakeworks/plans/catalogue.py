"""Every operator as a query over the given tables.

Each query takes the session and a directory of Parquet tables, reads whole tables and
returns a frame. Results are brought to plain types (``plain``) so that two engines can be
compared on them. Queries that exercise a writer put its table below the shared folder and
return what they read back from there.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeworks.functions.columns import by_bounds, iso_text, money, parse_date, parse_ts
from lakeworks.operators import batches, cleanse, files, metrics, profile, quality, report, sketch, synth
from lakeworks.operators.dedup import dedup
from lakeworks.operators.reconcile import locate_differences, reconcile, reconcile_counts
from lakeworks.operators.topk import latest_per_group
from lakeworks.plans import generate, medallion, migrate
from lakeworks.plans.incremental import IncrementalGold
from lakeworks.plans.loads import UniqueLoads
from lakeworks.plans.maintain import maintain
from lakeworks.plans.star import table, transactions
from lakeworks.schemas import RAW, RAW_COLUMNS, SILVER_STANDARD
from lakeworks.sources.audit import Gate
from lakeworks.sources import fs
from lakeworks.sources.files import file_inventory, read_files
from lakeworks.sources.scratch import new_folder
from lakeworks.sources.snapshots import SnapshotTable
from lakeworks.sources.variant import read_variant_lines, typed
from lakeworks.streaming import append, hybrid, newest, publish

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SOURCE_PATH = "lake://raw/transactions"
INGESTED_AT = datetime(2024, 1, 1)
MB = 1024**2
#: Rows of a file of the transactions that a query stores for itself, so that several tasks read them again.
FILE_ROWS = 100_000
#: Bytes of line items that make a file of a stream.
STREAM_FILE_BYTES = 4 * MB


def register(query: Query) -> Query:
    """Register under the function's name, less the underscore that keeps it off an import."""
    REGISTRY[query.__name__.rstrip("_")] = query
    return query


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, decimals as doubles."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        out.append(col.alias(f.name))
    return df.select(*out)


def is_damaged():
    """Rows whose id ends so stand for damaged input: the tables themselves have none."""
    return F.col("transaction_id").like("%-7")


def damaged(df: DataFrame, **values) -> DataFrame:
    """Replace columns of the damaged rows."""
    bad = is_damaged()
    return df.withColumns(
        {
            c: F.when(~bad, F.col(c)).otherwise(F.lit(v))
            for c, v in values.items()
        }
    )


# ---- sources


@register
def scan_parquet(spark, sf_dir):
    return plain(read_files(spark, f"{sf_dir}/orders.parquet", "parquet"))


@register
def scan_table(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part_catalogue")
    return spark.table("part_catalogue")


@register
def scan_formats(spark, sf_dir):
    """The same rows through orc, json and csv files."""
    source = table(spark, sf_dir, "customer")
    root, out = new_folder(spark, "formats"), None
    for fmt in ("orc", "json", "csv"):
        writer = source.write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{root}/{fmt}")
        rows = read_files(spark, f"{root}/{fmt}", fmt, source.schema).withColumn("fmt", F.lit(fmt))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- projections and filters


@register
def parse_ts_(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["transaction_id", "transaction_ts"])
    text = damaged(tx.withColumn("transaction_ts", iso_text("transaction_ts")), transaction_ts="nope")
    return text.select(
        "transaction_id",
        iso_text(parse_ts("transaction_ts")).alias("transaction_ts"),
        parse_date("transaction_ts").cast("string").alias("transaction_date"),
    )


@register
def decimal_cast(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["transaction_id", "amount", "balance_after"])
    text = tx.withColumns({c: F.col(c).cast("string") for c in ("amount", "balance_after")})
    bad = damaged(text, amount="bad", balance_after="1e20")
    return plain(
        bad.select(
            "transaction_id",
            money("amount").alias("amount"),
            money("balance_after").alias("balance_after"),
        )
    )


@register
def filter_status(spark, sf_dir):
    return cleanse.successful(transactions(spark, sf_dir, ["transaction_id", "status", "amount"]))


@register
def filter_amount(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir, ["transaction_id", "status", "amount"]), amount=0.004)
    return plain(cleanse.positive(tx.withColumn("amount", money("amount"))))


@register
def normalize_raw(spark, sf_dir):
    columns = ["transaction_id", "transaction_ts", "amount", "balance_after"]
    return cleanse.normalize_raw(transactions(spark, sf_dir, columns))


@register
def bronze_enrich(spark, sf_dir):
    bronze = cleanse.bronze_enrich(transactions(spark, sf_dir), SOURCE_PATH, INGESTED_AT)
    return plain(bronze)


# ---- cleansing and reporting


@register
def bronze_to_silver(spark, sf_dir):
    return plain(cleanse.bronze_to_silver(transactions(spark, sf_dir)))


@register
def dedup_keys(spark, sf_dir):
    tx = transactions(spark, sf_dir).withColumn("transaction_date", parse_date("transaction_ts"))
    return plain(dedup(tx, ["account_id", "transaction_date"], ["transaction_ts", "transaction_id", "amount"]))


@register
def identity_copy(spark, sf_dir):
    return table(spark, sf_dir, "customer")


@register
def gold_daily_report(spark, sf_dir):
    return plain(report.gold_daily_report(cleanse.bronze_to_silver(transactions(spark, sf_dir))))


@register
def recent_report(spark, sf_dir):
    """The last seven days of the data, as a stored report would be asked for them."""
    silver = cleanse.bronze_to_silver(transactions(spark, sf_dir))
    days = transactions(spark, sf_dir, ["status", "transaction_ts"]).transform(cleanse.successful)
    as_of = days.agg(F.max(parse_date("transaction_ts"))).scalar()
    return plain(report.recent_report(report.gold_daily_report(silver), as_of))


# ---- profiles


@register
def row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "lineitem"))


@register
def profile_nulls(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return profile.profile_nulls(damaged(tx, amount=None, status=None, merchant_name=None))


@register
def schema_findings(spark, sf_dir):
    columns = ["transaction_id", "account_id", "customer_id", "amount", "transaction_ts", "status"]
    tx = transactions(spark, sf_dir, columns).withColumn("amount", F.col("amount").cast("string"))
    tx = damaged(tx, amount="bad").withColumn("batch", F.when(~is_damaged(), F.lit("b1")))
    expected = {c: SILVER_STANDARD.columns[c] for c in (*columns, "currency", "channel")}
    return profile.schema_findings(tx, expected)


@register
def latest_k_per_group(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = latest_per_group(events, ["event_type"], 5, ["ts", "event_id"])
    return newest.select("event_type", "event_id", "rn")


@register
def latest_2000_per_group(spark, sf_dir):
    """More rows per group than Spark's own group limit takes."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber")
    newest = latest_per_group(items, ["l_returnflag"], 2000, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return newest.select("l_returnflag", "l_orderkey", "l_linenumber", "rn")


# ---- quality


def _report(df, rules, name="transactions"):
    return quality.quality_report(df, rules, name).select(
        "rule", "violations", "row_count", "passed", "message"
    )


@register
def dq_not_null(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir, ["transaction_id", "amount"]), amount=None)
    return _report(
        tx,
        [
            quality.not_null("amount", name="amount_strict"),
            quality.not_null("amount", 0.5, name="amount_lenient"),
        ],
    )


@register
def dq_positive(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir, ["transaction_id", "amount"]), amount=-1.0)
    return _report(tx, [quality.positive_amount()])


@register
def dq_allowed(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir, ["transaction_id", "status"]), status=None)
    return _report(tx, [quality.allowed_values("status", ["SUCCESS", "FAILED"])])


@register
def disallowed_values(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir, ["transaction_id", "status"]), status=None)
    return quality.disallowed_values(tx, "status", ["SUCCESS", "FAILED"])


@register
def br_balance(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["amount", "balance_after"])
    return _report(tx, [quality.balance_check()])


@register
def br_unique_id(spark, sf_dir):
    return _report(transactions(spark, sf_dir, ["transaction_id"]), [quality.unique_id()])


@register
def business_rules(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["transaction_id", "amount", "balance_after"])
    return _report(tx, quality.business_rules())


@register
def quality_report(spark, sf_dir):
    tx = damaged(transactions(spark, sf_dir), merchant_name=None)
    rules = [
        quality.rule("id_present", "not_null", column="transaction_id"),
        quality.rule("merchant_present", "not_null", column="merchant_name", max_null_ratio=0.01),
        quality.rule("amount_positive", "positive_amount", column="amount"),
        quality.rule("status_known", "allowed_values", column="status", values=["SUCCESS", "FAILED", "PENDING"]),
        *quality.business_rules(),
    ]
    return quality.quality_report(tx, rules, "transactions").drop("ratio")


@register
def table_standard(spark, sf_dir):
    tx = cleanse.bronze_enrich(transactions(spark, sf_dir), SOURCE_PATH, INGESTED_AT).drop("channel")
    tx = damaged(tx, amount=None)
    return _report(tx, quality.standard_rules(tx, SILVER_STANDARD))


# ---- migration


def _orders_as_files(spark, sf_dir):
    """One file per order: its price in cents is its size."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("orders/"), "o_orderkey").alias("path"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("length"),
        F.col("o_orderkey").alias("batch_id"),
    )


def _items_as_attempts(spark, sf_dir):
    """One attempt per line item at migrating the batch of its order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("attempt"),
        F.col("l_quantity").cast("long").alias("row_count"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes_processed"),
        (F.col("l_returnflag") == "N").alias("success"),
    )


@register
def reconcile_counts_(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["transaction_id", "amount"])
    return reconcile_counts(tx, tx.where(~is_damaged()))


@register
def reconcile_content(spark, sf_dir):
    tx = transactions(spark, sf_dir, ["transaction_id", "account_id", "amount"])
    same = reconcile(tx, tx.repartition("account_id")).withColumn("pair", F.lit("reordered"))
    changed = reconcile(tx, damaged(tx, amount=None)).withColumn("pair", F.lit("changed"))
    return same.unionByName(changed)


@register
def reconcile_types(spark, sf_dir):
    """The same values, in a wider type on one side and as text in the other."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    wider = reconcile(events.withColumn("user_id", F.col("user_id").cast("int")), events)
    text = reconcile(events, events.withColumn("user_id", F.col("user_id").cast("string")))
    return wider.withColumn("pair", F.lit("wider")).unionByName(text.withColumn("pair", F.lit("text")))


@register
def batch_plan(spark, sf_dir):
    return batches.batch_plan(_orders_as_files(spark, sf_dir), 2000 * MB)


@register
def batch_summary(spark, sf_dir):
    return batches.batch_summary(_orders_as_files(spark, sf_dir), 2000 * MB)


@register
def batches_to_retry(spark, sf_dir):
    return batches.batches_to_retry(_orders_as_files(spark, sf_dir), _items_as_attempts(spark, sf_dir), 3)


@register
def migration_progress(spark, sf_dir):
    log = _items_as_attempts(spark, sf_dir)
    return batches.migration_progress(log, 1_000_000, 10**14, 3600.0, 4000)


# ---- files and maintenance


def _items_as_manifest(spark, sf_dir):
    """One snapshot per ship month; a part and line number name a file."""
    month = F.trunc("l_shipdate", "month")
    return table(spark, sf_dir, "lineitem").select(
        (F.year(month) * 12 + F.month(month)).cast("long").alias("snapshot_id"),
        month.cast("timestamp").alias("committed_at"),
        F.concat_ws("-", "l_partkey", "l_linenumber").alias("path"),
        "l_returnflag",
        F.col("l_shipdate").cast("timestamp").alias("modificationTime"),
    )


def _items_as_listing(spark, sf_dir):
    """Files of one table per supplier and line number, sized by price."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_suppkey", "l_linenumber").alias("table"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"),
    )


@register
def file_inventory_(spark, sf_dir):
    """The data files of the given tables themselves."""
    names = [
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    ]
    listing = file_inventory(spark, {n: f"{sf_dir}/{n}.parquet" for n in names})
    return files.file_stats(listing)


@register
def file_size_sketch(spark, sf_dir):
    """Size quantiles from the sketches of three listings, one of which lists files that were deleted since."""
    root = new_folder(spark, "sketch")
    listing = _items_as_listing(spark, sf_dir)
    third = F.pmod(F.xxhash64("table", "length"), F.lit(3))
    removed = listing.withColumn("length", F.col("length") * 3)
    sweeps = [listing.where(third == 0).unionAll(removed), listing.where(third > 0), removed]
    for i, files_seen in enumerate(sweeps):
        sketch.size_sketch(files_seen).write.parquet(f"{root}/sweep={i}")
    first, second, gone = [spark.read.parquet(f"{root}/sweep={i}") for i in range(3)]
    return sketch.size_quantiles(sketch.merge_sketches([first, second], [gone]), (0.1, 0.5, 0.9, 1.0))


@register
def file_stats(spark, sf_dir):
    return files.file_stats(_items_as_listing(spark, sf_dir))


@register
def maintenance_plan(spark, sf_dir):
    stats = files.file_stats(_items_as_listing(spark, sf_dir)).select("table", "file_count")
    return files.maintenance_plan(stats, "intelligent")


@register
def maintenance_hybrid(spark, sf_dir):
    stats = files.file_stats(_items_as_listing(spark, sf_dir)).select("table", "file_count")
    return files.maintenance_plan(stats, "hybrid", sort_columns=["transaction_ts"])


@register
def expired_snapshots(spark, sf_dir):
    return plain(files.expired_snapshots(_items_as_manifest(spark, sf_dir), 30))


@register
def expired_files(spark, sf_dir):
    return files.expired_files(_items_as_manifest(spark, sf_dir), 30)


@register
def orphan_files(spark, sf_dir):
    rows = _items_as_manifest(spark, sf_dir)
    listing = rows.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"))
    known = rows.where("l_returnflag = 'R'")
    return plain(files.orphan_files(listing, known, F.lit(datetime(2000, 1, 1))))


# ---- run metrics


def _events_as_runs(spark, sf_dir):
    """One run per event."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), "user_id").alias("job"),
        F.element_at(
            F.array(*[F.lit(n) for n in ("critical_etl", "batch_migration", "analytical_workload")]),
            F.pmod("user_id", F.lit(3)).cast("int") + 1,
        ).alias("sla_name"),
        (F.col("value") * 40).alias("duration_seconds"),
        F.when(F.col("event_type") != "click", F.col("event_id")).alias("output_count"),
        F.col("user_id").alias("target_count"),
        (F.col("event_id") * 1000).alias("bytes_processed"),
        (F.col("event_type") != "error").alias("success"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def _events_as_checks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sla_name"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("quality_score"),
        F.col("event_id").alias("row_count"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@register
def throughput(spark, sf_dir):
    out = metrics.throughput(_events_as_runs(spark, sf_dir))
    return out.select("event_id", "job", "rows_per_second", "bytes_per_second")


@register
def latest_throughput(spark, sf_dir):
    return plain(metrics.latest_throughput(_events_as_runs(spark, sf_dir)))


@register
def sla_compliance(spark, sf_dir):
    return metrics.sla_compliance(_events_as_runs(spark, sf_dir))


@register
def sla_unknown(spark, sf_dir):
    """Runs of an SLA without a profile, and runs of none, are reported as well."""
    runs = _events_as_runs(spark, sf_dir)
    # Clicks, which have no output count, and errors, which did not succeed.
    other = F.when(F.col("output_count").isNull(), F.lit("nightly")).when(F.col("success"), F.col("sla_name"))
    return metrics.sla_compliance(runs.withColumn("sla_name", other))


@register
def quality_summary(spark, sf_dir):
    mean = F.round("average_quality_score", 6).alias("average_quality_score")
    log = _events_as_checks(spark, sf_dir)
    return metrics.quality_summary(log, ["sla_name"]).select("sla_name", "checks", mean)


@register
def latest_checks(spark, sf_dir):
    return plain(metrics.latest_checks(_events_as_checks(spark, sf_dir), 10, ["ts", "row_count"]))


# ---- synthetic data


@register
def synthetic_transactions(spark, sf_dir):
    """One synthetic transaction per order."""
    return synth.synthetic_transactions(table(spark, sf_dir, "orders"), "o_orderkey", seed=42)


@register
def synthetic_domains(spark, sf_dir):
    """What must hold of the synthetic rows whatever was drawn: counts of rows that break it."""
    rows = synth.synthetic_transactions(table(spark, sf_dir, "lineitem"), "l_orderkey", seed=42)
    ts = F.col("transaction_ts")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("transaction_id").alias("n_ids"),
        F.count_if(~F.col("amount").between(10, 500000)).alias("bad_amount"),
        F.count_if(~F.col("balance_after").between(0, 2000000)).alias("bad_balance"),
        F.count_if(~F.col("transaction_type").isin(synth.TRANSACTION_TYPES)).alias("bad_type"),
        F.count_if(~F.col("channel").isin(synth.CHANNELS)).alias("bad_channel"),
        F.count_if(~F.col("status").isin(list(synth.STATUS_WEIGHTS))).alias("bad_status"),
        F.count_if(~ts.rlike(r"^202[456]-\d\d-\d\dT\d\d:\d\d:00$") | parse_ts(ts).isNull()).alias("bad_ts"),
        F.count_if(~F.col("account_id").rlike(r"^ACC\d{6}$")).alias("bad_account"),
    )


def _learnable(spark, sf_dir):
    """The transactions as a stored table in several files: learning reads it a few times."""
    path = f"{new_folder(spark, 'learn')}/source"
    # Files of so many rows, rather than a shuffle of whole rows to a number of tasks that does not grow.
    transactions(spark, sf_dir).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.parquet(path)


@register
def synthetic_learned(spark, sf_dir):
    """As many rows as there are transactions, drawn from what is learned from all of them."""
    source = _learnable(spark, sf_dir)
    learned = synth.learn_transactions(source)
    return synth.learned_transactions(source.select("transaction_id"), learned, "transaction_id", seed=42)


# What learned rows may differ by from their source: the null shares, the correlations, and (beside
# what so many draws of so many values differ by at most) the distributions of values.
NULL_TOLERANCE = 0.01
CORRELATION_TOLERANCE = 0.12
DISTANCE_TOLERANCE = 0.01


@register
def synthetic_learned_fit(spark, sf_dir):
    """Per column of the learned rows: how many there are, and whether they fit their source.

    The source has nulls in some columns. ``nulls_fit`` compares the share of nulls. ``shares_fit``
    bounds the total variation distance of the values (of numbers and times: of the tenths of the
    source they fall in), which two tables of n rows with k values have by chance up to about
    sqrt(k / n). ``unknown_values`` counts rows with a value the source does not have. The row
    ``correlations`` says whether all pairs of columns correlate as they do in the source.
    """
    root = new_folder(spark, "fit")
    line = F.substring_index("transaction_id", "-", -1)
    source = _learnable(spark, sf_dir).withColumns(
        {
            "merchant_name": F.when(line != "2", F.col("merchant_name")),
            "channel": F.when(line != "3", F.col("channel")),
            "amount": F.when(line != "4", F.col("amount")),
        }
    )
    learned = synth.learn_transactions(source)
    keys = source.select("transaction_id")
    synth.learned_transactions(keys, learned, "transaction_id", seed=42).write.parquet(f"{root}/made")
    made = spark.read.parquet(f"{root}/made")
    numbers = ["amount", "balance_after", "transaction_ts"]
    valued_columns = [c for c in RAW_COLUMNS if c != "transaction_id"]
    seconds = {"transaction_ts": parse_ts("transaction_ts").cast("double")}
    tenths = [i / 10 for i in range(1, 10)]
    bounds = (
        source.withColumns(seconds).agg(*[F.percentile_approx(c, tenths, 10000).alias(c) for c in numbers]).first()
    )

    def valued(rows, side):
        rows = rows.withColumns(seconds)
        values = {c: F.col(c).cast("string") for c in RAW_COLUMNS if c not in numbers and c != "transaction_id"}
        for c in numbers:
            tenth = by_bounds(F.col(c).cast("double"), bounds[c], [str(i) for i in range(10)])
            values[c] = F.when(F.col(c).isNotNull(), tenth)
        return synth.by_column(rows, {c: values[c] for c in valued_columns}, F.lit(int(side == "here")).alias("here"))

    counts = valued(source, "here").unionAll(valued(made, "there")).groupBy("place", "value").agg(
        F.sum("here").alias("here"), (F.count(F.lit(1)) - F.sum("here")).alias("there")
    ).withColumn("column", synth.column_at("place", valued_columns))
    null = F.col("value").isNull()
    gap = F.abs(F.col("there") - F.col("here"))
    n, distinct = F.col("n"), F.col("distinct")
    fits = (
        counts.groupBy("column")
        .agg(
            F.sum("there").alias("n"),
            F.coalesce(F.sum(F.when(null, gap)), F.lit(0)).alias("null_gap"),
            F.sum(F.when(~null, gap)).alias("gap"),
            F.count_if(~null).alias("distinct"),
            F.coalesce(F.sum(F.when(F.col("here") == 0, F.col("there"))), F.lit(0)).alias("unknown_values"),
        )
        .select(
            "column",
            "n",
            (F.col("null_gap") <= NULL_TOLERANCE * n).alias("nulls_fit"),
            (F.col("gap") / 2 <= (DISTANCE_TOLERANCE + F.sqrt(distinct / n)) * n).alias("shares_fit"),
            "unknown_values",
        )
    )
    ids = made.join(keys.withColumnRenamed("transaction_id", "known"), F.col("transaction_id") == F.col("known"), "left")
    ids = ids.agg(
        F.lit("transaction_id").alias("column"),
        F.count_distinct("transaction_id").alias("n"),
        (F.count_if(F.col("transaction_id").isNull()) == 0).alias("nulls_fit"),
        # Ids are made anew: none of them may be one of the source's.
        (F.count_if(F.col("known").isNotNull()) == 0).alias("shares_fit"),
        F.count_if(~F.col("transaction_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("unknown_values"),
    )
    off = abs(synth.score_correlation(made, learned) - learned.correlation)
    pairs = len(off) * (len(off) - 1) // 2
    linked = spark.range(1).select(
        F.lit("correlations").alias("column"),
        F.lit(pairs).cast("long").alias("n"),
        F.lit(True).alias("nulls_fit"),
        F.lit(bool(off.max() <= CORRELATION_TOLERANCE)).alias("shares_fit"),
        F.lit(int((off > CORRELATION_TOLERANCE).sum()) // 2).cast("long").alias("unknown_values"),
    )
    return fits.unionByName(ids).unionByName(linked)


# ---- writers, read back


def _raw_json(spark, sf_dir, root):
    """The transactions as JSON lines, timestamps as ISO text; compressed, and so in files of few rows."""
    tx = transactions(spark, sf_dir).withColumn("transaction_ts", iso_text("transaction_ts"))
    tx.write.option("maxRecordsPerFile", FILE_ROWS).json(f"{root}/raw", compression="gzip")
    return f"{root}/raw"


def _stream_files(spark, sf_dir, least):
    """Files to deal a stream's rows to: their number grows with the line items, their size does not."""
    size = file_inventory(spark, {"t": f"{sf_dir}/lineitem.parquet"}).agg(F.sum("length")).first()[0]
    return max(least, -(-size // STREAM_FILE_BYTES))


@register
def ingest_json(spark, sf_dir):
    """JSON lines to a published bronze table."""
    root = new_folder(spark, "ingest")
    bronze = SnapshotTable(f"{root}/bronze", ("status",))
    raw = _raw_json(spark, sf_dir, root)
    medallion.ingest_json(spark, raw, bronze, ingest_ts=INGESTED_AT, log=f"{root}/log")
    return plain(bronze.read(spark).drop("source_path"))


@register
def medallion_report(spark, sf_dir):
    """JSON lines to bronze, silver and gold, each stored; returns the stored report."""
    root = new_folder(spark, "medallion")
    # Coarse partitions: the tables spread few rows over 2,500 days. See layer_tables.
    bronze = SnapshotTable(f"{root}/bronze", ("status",))
    silver = SnapshotTable(f"{root}/silver", ("channel",))
    gold = SnapshotTable(f"{root}/gold", ("channel",))
    raw = _raw_json(spark, sf_dir, root)
    medallion.ingest_json(spark, raw, bronze, ingest_ts=INGESTED_AT, log=f"{root}/log")
    gate = Gate([quality.positive_amount(), quality.unique_id()], min_rows=1)
    medallion.bronze_to_gold(spark, bronze, silver, gold, gate, f"{root}/log")
    return plain(gold.read(spark))


@register
def migrate_dataset(spark, sf_dir):
    """A file dataset to a table, appended in two loads, counts checked for each."""
    target = SnapshotTable(f"{new_folder(spark, 'migrate')}/orders", ("o_orderstatus",))
    source = f"{sf_dir}/orders.parquet"
    migrate.migrate_files(spark, source, target, mode="create")
    migrate.migrate_files(spark, source, target, mode="append")
    return plain(target.read(spark))


@register
def migrate_batched(spark, sf_dir):
    """A file dataset of 200 files, copied in about as many batches from a plan."""
    root = new_folder(spark, "batched")
    table(spark, sf_dir, "lineitem").repartition(200).write.parquet(f"{root}/source")
    size = file_inventory(spark, {"t": f"{root}/source"}).agg(F.sum("length")).first()[0]
    migrate.migrate_in_batches(spark, f"{root}/source", f"{root}/target", batch_bytes=size // 200)
    return plain(migrate.read_batches(spark, f"{root}/target"))


@register
def reconcile_drilldown(spark, sf_dir):
    """Orders against a copy in which some are changed, missing, new or there twice: which ones."""
    orders = table(spark, sf_dir, "orders")
    kind = F.pmod("o_orderkey", F.lit(1000))
    copy = orders.where(kind != 8).withColumn(
        "o_totalprice", F.when(kind == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    new = orders.where(kind == 9).withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    copy = copy.unionAll(new).unionAll(orders.where(kind == 10)).repartition(7)
    return locate_differences(orders, copy, ["o_orderkey"]).select("o_orderkey", "status")


@register
def migrate_batched_drift(spark, sf_dir):
    """JSON files that differ in their columns, copied batch by batch."""
    root = new_folder(spark, "drift")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    for flag, column in ((True, "value"), (False, "user_id")):
        part = events.where((F.col("event_type") == "click") == flag).select("event_id", "event_type", column)
        part.repartition(3).write.mode("append").json(f"{root}/source")
    size = file_inventory(spark, {"t": f"{root}/source"}).agg(F.sum("length")).first()[0]
    migrate.migrate_in_batches(
        spark, f"{root}/source", f"{root}/target", "json", batch_bytes=max(1, size // 4)
    )
    return migrate.read_batches(spark, f"{root}/target").select("event_id", "event_type", "value", "user_id")


@register
def ingest_quarantine(spark, sf_dir):
    """JSON lines of which some are cut off: where each one went."""
    root = new_folder(spark, "quarantine")
    bronze = SnapshotTable(f"{root}/bronze")
    tx = transactions(spark, sf_dir).withColumn("transaction_ts", iso_text("transaction_ts"))
    lines = tx.select("transaction_id", F.to_json(F.struct("*")).alias("value"))
    cut = F.when(is_damaged(), F.expr("left(value, length(value) - 3)")).otherwise(F.col("value"))
    # Written once, cut and compressed.
    lines.select(cut.alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(f"{root}/cut", compression="gzip")
    medallion.ingest_json(spark, f"{root}/cut", bronze, quarantine_path=f"{root}/bad", ingest_ts=INGESTED_AT)
    bad = spark.read.text(f"{root}/bad").select(F.lit("bad").alias("place"))
    placed = bronze.read(spark).select(F.lit("bronze").alias("place")).unionAll(bad)
    return placed.groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@register
def dedup_append(spark, sf_dir):
    """Loads that overlap: order lines by digit, some of them in two loads, then all of them again."""
    target = UniqueLoads(new_folder(spark, "unique"), ["l_orderkey", "l_linenumber"])
    items, digit = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") % 10
    target.add(items.where(digit < 6), "first")
    target.add(items.where(digit > 3), "second")
    target.add(items.unionAll(items), "third")
    return plain(target.read(spark))


@register
def ingest_variant(spark, sf_dir):
    """JSON lines in two shapes, some cut off: typed columns, what fits none of them, and the bad lines."""
    root = new_folder(spark, "variant")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    is_click = F.coalesce(F.col("event_type") == "click", F.lit(False))
    amount = F.struct(F.col("value").alias("amount"), F.lit("x").alias("unit"))
    drifted = events.where(is_click).select("event_id", "event_type", amount.alias("value"), "user_id")
    for part in (drifted, events.where(~is_click).drop("user_id")):
        line = F.to_json(F.struct("*"))
        cut = F.when(F.col("event_id") % 100 == 7, F.concat(F.lit("{"), line)).otherwise(line)
        part.select(cut.alias("value")).write.mode("append").text(f"{root}/lines")
    lines = typed(read_variant_lines(spark, f"{root}/lines"), {"event_id": "bigint", "event_type": "string", "value": "double"})
    lines.write.parquet(f"{root}/bronze")
    bronze = spark.read.parquet(f"{root}/bronze")
    late = lambda path, kind: F.try_variant_get("document", path, kind)
    return bronze.select(
        "event_id",
        "event_type",
        "value",
        F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_fields"),
        late("$.user_id", "bigint").alias("user_id"),
        late("$.value.amount", "double").alias("amount"),
        F.regexp_extract("bad_line", r'"event_id":([0-9]+)', 1).alias("bad_event"),
    )


@register
def gold_incremental(spark, sf_dir):
    """The report of three loads: two periods of years, then late rows of all; one load comes twice."""
    root = new_folder(spark, "incremental")
    late = F.pmod(F.xxhash64("transaction_id"), F.lit(10)) == 0
    load = F.when(late, "late").when(F.year("transaction_date") < 1995, "early").otherwise("recent")
    cleanse.bronze_to_silver(transactions(spark, sf_dir)).withColumn("load", load).write.parquet(f"{root}/silver")
    silver = spark.read.parquet(f"{root}/silver")
    # Periods of years: see medallion_report.
    gold = IncrementalGold(f"{root}/gold", "year")
    for name in ("early", "recent", "late", "recent"):
        gold.add(silver.where(F.col("load") == name).drop("load"), name)
    return plain(gold.read(spark))


@register
def copy_deduplicated(spark, sf_dir):
    """Table to table with one row per key, with a gate on the number of rows."""
    root = new_folder(spark, "copy")
    source, target = SnapshotTable(f"{root}/source"), SnapshotTable(f"{root}/target")
    columns = ["transaction_id", "amount", "transaction_ts", "merchant_name"]
    source.write(transactions(spark, sf_dir, columns))
    migrate.copy_table(spark, source, target, ["transaction_id"], min_rows=1)
    return plain(target.read(spark))


@register
def compacted_table(spark, sf_dir):
    """A table of many small files, compacted by the maintenance job."""
    target = SnapshotTable(f"{new_folder(spark, 'compact')}/orders", ("o_orderpriority",))
    orders = table(spark, sf_dir, "orders")
    for _ in range(2):
        target.write(orders, "append")
    maintain(spark, {"orders": target}, "intelligent", force=True)
    target.compact(spark)
    return plain(target.read(spark))


@register
def sorted_table(spark, sf_dir):
    """A table rewritten in the order of a column by the maintenance job."""
    target = SnapshotTable(f"{new_folder(spark, 'sorted')}/lineitem")
    target.write(table(spark, sf_dir, "lineitem"))
    maintain(spark, {"lineitem": target}, "hybrid", force=True, sort_columns=["l_shipdate"])
    return plain(target.read(spark))


@register
def zorder_table(spark, sf_dir):
    """A table rewritten in the interleaved order of two columns by the maintenance job."""
    target = SnapshotTable(f"{new_folder(spark, 'zorder')}/lineitem")
    target.write(table(spark, sf_dir, "lineitem"))
    columns = ["l_shipdate", "l_partkey"]
    maintain(spark, {"lineitem": target}, "hybrid", force=True, sort_columns=columns, zorder=True)
    return plain(target.read(spark))


@register
def orphans_of_a_crash(spark, sf_dir):
    """Rows in the files of writes that broke off, before and after their tasks were done, as found among the orphans."""
    target = SnapshotTable(f"{new_folder(spark, 'crash')}/orders")
    orders = table(spark, sf_dir, "orders")
    target.write(orders)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    orders.where(urgent).write.parquet(f"{target.root}/data/load=done")
    orders.where(~urgent).write.parquet(f"{target.root}/data/load=begun/_temporary/0/_temporary/attempt_0")
    soon = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    lost = target.orphan_files(spark, soon).select("path")
    begun = F.col("path").contains("/_temporary/")
    files = lost.agg(F.collect_list(F.when(begun, F.col("path"))), F.collect_list(F.when(~begun, F.col("path")))).first()
    rows = [spark.read.parquet(*f).select(F.lit(place).alias("place")) for f, place in zip(files, ("begun", "done"))]
    return rows[0].unionAll(rows[1]).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@register
def stream_append(spark, sf_dir):
    """JSON lines streamed through a transform into a Parquet table."""
    root = new_folder(spark, "stream")
    raw = append.read_stream(spark, "json", RAW, _raw_json(spark, sf_dir, root))
    rows = cleanse.valid_rows(raw)
    append.append_stream(
        rows, f"{root}/checkpoint", path=f"{root}/target", available_now=True
    ).awaitTermination()
    return plain(spark.read.parquet(f"{root}/target"))


@register
def stream_silver(spark, sf_dir):
    """Silver rows, each sent twice, deduplicated on the stream."""
    root = new_folder(spark, "silver")
    silver = cleanse.bronze_to_silver(transactions(spark, sf_dir))
    raw = silver.withColumn("transaction_ts", iso_text("transaction_ts")).select(*RAW_COLUMNS)
    files = _stream_files(spark, sf_dir, 6)
    raw.unionAll(raw).repartition(files).write.json(f"{root}/raw", compression="gzip")
    rows = append.silver_stream(append.read_stream(spark, "json", RAW, f"{root}/raw", per_batch=-(-files // 3)))
    append.append_stream(
        rows, f"{root}/checkpoint", path=f"{root}/target", available_now=True
    ).awaitTermination()
    return plain(spark.read.parquet(f"{root}/target"))


@register
def stream_silver_damaged(spark, sf_dir):
    """Rows whose time is no time stay on the stream, as they do in a batch."""
    root = new_folder(spark, "damaged")
    raw = transactions(spark, sf_dir).withColumn("transaction_ts", iso_text("transaction_ts"))
    # One row per id first: which of several stays would hang on the order of arrival.
    raw = dedup(raw, ["transaction_id"], ["transaction_ts", "amount", "merchant_name", "merchant_category"])
    files = _stream_files(spark, sf_dir, 6)
    damaged(raw, transaction_ts="no time").repartition(files).write.json(f"{root}/raw", compression="gzip")
    rows = append.silver_stream(append.read_stream(spark, "json", RAW, f"{root}/raw", per_batch=-(-files // 3)))
    append.append_stream(
        rows, f"{root}/checkpoint", path=f"{root}/target", available_now=True
    ).awaitTermination()
    return plain(spark.read.parquet(f"{root}/target"))


@register
def stream_silver_newest(spark, sf_dir):
    """Raw rows whose ids occur in several versions, spread over several batches of a stream."""
    root = new_folder(spark, "newest")
    raw = transactions(spark, sf_dir).withColumn("transaction_ts", iso_text("transaction_ts"))
    # The first lines of orders twice more, with a smaller amount before and a day older after.
    again = raw.where(F.col("transaction_id").endswith("-1"))
    older = again.withColumns(
        {
            "transaction_ts": iso_text(parse_ts("transaction_ts") - F.expr("INTERVAL 1 DAY")),
            "merchant_name": F.lit("superseded"),
        }
    )
    smaller = again.withColumns({"amount": F.col("amount") / 2, "merchant_name": F.lit("superseded")})
    files = _stream_files(spark, sf_dir, 2)
    for part in (smaller, raw, older):
        part.repartition(files).write.mode("append").json(f"{root}/raw", compression="gzip")
    # The stream ends with its input, so no key needs to be forgotten.
    rows = newest.silver_newest_stream(append.read_stream(spark, "json", RAW, f"{root}/raw", per_batch=files), keep_ms=None)
    with newest.keyed_state(spark):
        publish.publish_stream(
            rows, f"{root}/target", f"{root}/checkpoint", output_mode="update", available_now=True
        ).awaitTermination()
    return plain(newest.of_last_epoch(publish.read_published(spark, f"{root}/target", rows.schema), ["transaction_id"]))


@register
def stream_published(spark, sf_dir):
    """Events through a gate, with a batch that runs again from copied checkpoints, published before or not."""
    root = new_folder(spark, "published")
    events = table(spark, sf_dir, "events")
    events.repartition(6).write.json(f"{root}/arriving")
    gate = Gate([quality.not_null("event_id")], min_rows=1)

    def run(checkpoint):
        stream = append.read_stream(spark, "json", events.schema, f"{root}/arriving", per_batch=2)
        publish.publish_stream(
            stream, f"{root}/target", f"{root}/{checkpoint}", gate, ["event_type"], available_now=True
        ).awaitTermination()

    run("checkpoint")
    # The driver lost in the last batch: after it was published, and then before.
    for name, published in (("after", True), ("before", False)):
        fs.copy(spark, f"{root}/checkpoint", f"{root}/{name}")
        fs.delete(spark, f"{root}/{name}/commits/2")
        if not published:
            fs.delete(spark, f"{root}/target/published/{2:012d}.json")
        run(name)
    return plain(publish.read_published(spark, f"{root}/target", events.schema).drop("epoch"))


@register
def hybrid_partitions(spark, sf_dir):
    """A hand-over in which every partition of the source has got to another place."""
    root = new_folder(spark, "partitions")
    events = table(spark, sf_dir, "events").withColumn("part", F.pmod("user_id", F.lit(4)))
    events.repartition(4).write.json(f"{root}/arriving")
    stream = append.read_stream(spark, "json", events.schema, f"{root}/arriving", per_batch=2)
    hybrid.backfill_then_stream(
        # The first has got furthest, the last has no row in the backfill.
        events.where("part < 3 AND dayofmonth(ts) < 20 - 5 * part"),
        stream,
        "event_id",
        f"{root}/target",
        f"{root}/checkpoint",
        available_now=True,
        partition="part",
    ).query.awaitTermination()
    return plain(hybrid.read_hybrid(spark, f"{root}/target").drop("part"))


@register
def hybrid_append(spark, sf_dir):
    """Events of the first half of the month in a batch, the rest by the stream that follows."""
    root = new_folder(spark, "hybrid")
    events = table(spark, sf_dir, "events")
    events.write.json(f"{root}/arriving")
    stream = append.read_stream(spark, "json", events.schema, f"{root}/arriving")
    hybrid.backfill_then_stream(
        events.where("ts < '2024-01-15'"),
        stream,
        "event_id",
        f"{root}/target",
        f"{root}/checkpoint",
        available_now=True,
    ).query.awaitTermination()
    return plain(hybrid.read_hybrid(spark, f"{root}/target"))


@register
def generated_json_lines(spark, sf_dir):
    """JSON lines like the transactions, for as many bytes as the orders have on storage.

    The values of two columns, with whether the size was reached, whether there are as many lines
    as the manifest says, and how many rows hold a country the source has not.
    """
    root = new_folder(spark, "generate")
    wanted = file_inventory(spark, {"t": f"{sf_dir}/orders.parquet"}).agg(F.sum("length")).first()[0]
    learned = synth.learn_transactions(_learnable(spark, sf_dir))
    manifest = generate.generate_json_lines(
        spark, f"{root}/out", wanted, 4 * MB, make=lambda ids: synth.learned_transactions(ids, learned)
    )
    size = F.sum(F.octet_length("value") + 1)
    whole = spark.read.text(f"{root}/out").agg(
        (size >= wanted).alias("reached"), (F.count(F.lit(1)) == manifest["total_rows"]).alias("counted")
    )
    rows = spark.read.schema(RAW).json(f"{root}/out")
    foreign = rows.join(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("country_code")), "country_code", "left_anti"
    ).agg(F.count(F.lit(1)).alias("foreign_rows"))
    names = ("transaction_type", "channel")
    values = rows.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("column", "value"))
    facts = whole.join(foreign, F.lit(True)).first()
    return values.distinct().withColumns({c: F.lit(facts[c]) for c in facts.asDict()})
