"""The catalogue's queries in SQL, over the same tables, for an independent engine (DuckDB)."""

from __future__ import annotations

_TX = """
tx AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS transaction_id,
         concat('ACC', o_custkey) AS account_id,
         concat('CUST', c_custkey) AS customer_id,
         o_orderpriority AS transaction_type,
         l_extendedprice AS amount,
         'INR' AS currency,
         s_name AS merchant_name,
         p_type AS merchant_category,
         c_mktsegment AS channel,
         l_shipdate AS transaction_ts,
         concat('BR', n_nationkey) AS branch_code,
         CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
         c_acctbal AS balance_after,
         n_name AS country_code
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON c_nationkey = n_nationkey
)"""

_VALID = f"""{_TX},
valid AS (
  SELECT transaction_id, account_id, customer_id, transaction_type,
         CAST(amount AS DECIMAL(18,2)) AS amount, currency, merchant_name, merchant_category, channel,
         transaction_ts, CAST(transaction_ts AS DATE) AS transaction_date, branch_code, status,
         CAST(balance_after AS DECIMAL(18,2)) AS balance_after, country_code
  FROM tx
  WHERE status = 'SUCCESS' AND CAST(amount AS DECIMAL(18,2)) > 0
)"""

_SILVER = f"""{_VALID},
silver AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (
    PARTITION BY transaction_id
    ORDER BY transaction_ts DESC, amount DESC, merchant_name DESC, merchant_category DESC) = 1
)"""

# Spark's mean of decimals is rounded half up to six places, then to two.
_GOLD = f"""{_SILVER},
gold AS (
  SELECT transaction_date AS report_date, merchant_category, channel, currency,
         CAST(count(*) AS BIGINT) AS transaction_count,
         CAST(sum(amount) AS DECIMAL(18,2)) AS total_amount,
         CAST((((CAST(sum(amount) * 100 AS HUGEINT) * 20000 + count(*)) // (2 * count(*)) + 5000)
               // 10000) / 100.0 AS DECIMAL(18,2)) AS avg_amount,
         CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers
  FROM silver
  GROUP BY ALL
)"""

_VALID_OUT = """
SELECT transaction_id, account_id, customer_id, transaction_type, CAST(amount AS DOUBLE) AS amount, currency,
       merchant_name, merchant_category, channel, strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') AS transaction_ts,
       strftime(transaction_date, '%Y-%m-%d') AS transaction_date, branch_code, status,
       CAST(balance_after AS DOUBLE) AS balance_after, country_code"""

_GOLD_OUT = """
SELECT strftime(report_date, '%Y-%m-%d') AS report_date, merchant_category, channel, currency, transaction_count,
       CAST(total_amount AS DOUBLE) AS total_amount, CAST(avg_amount AS DOUBLE) AS avg_amount, unique_customers
FROM gold"""

_ORDERS_OUT = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders"""

_LINEITEM_OUT = """
SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem"""

_BRONZE = """
SELECT transaction_id, account_id, customer_id, transaction_type, amount, currency, merchant_name,
       merchant_category, channel, {ts} AS transaction_ts, branch_code, status, balance_after, country_code,
       '2024-01-01 00:00:00' AS ingest_ts, {path} strftime(transaction_ts, '%Y-%m-%d') AS transaction_date
FROM tx"""

_FILES = """
files AS (
  SELECT concat('orders/', o_orderkey) AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS length,
         o_orderkey AS batch_id
  FROM orders
)"""

_ATTEMPTS = """
state AS (
  SELECT l_orderkey AS batch_id, count(*) AS attempts, bool_or(l_returnflag = 'N') AS done,
         coalesce(max(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS row_count,
         coalesce(max(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag = 'N'), 0)
           AS bytes_processed
  FROM lineitem
  GROUP BY l_orderkey
)"""

_LISTING = """
listing AS (
  SELECT concat(l_suppkey, '-', l_linenumber) AS "table",
         CAST(round(l_extendedprice * 100) AS BIGINT) AS length
  FROM lineitem
),
stats AS (SELECT "table", count(*) AS file_count FROM listing GROUP BY "table")"""

_PREDICTED = """
CASE WHEN file_count >= 100 THEN 'HIGH' WHEN file_count >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
CAST(CASE WHEN file_count >= 100 THEN 0.9 WHEN file_count >= 50 THEN 0.6 ELSE 0.2 END AS DOUBLE) AS urgency_score,
file_count >= 50 AS requires_compaction"""

_MANIFEST = """
manifest AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS snapshot_id,
         date_trunc('month', l_shipdate) AS committed_at,
         concat(l_partkey, '-', l_linenumber) AS path, l_returnflag, l_shipdate
  FROM lineitem
),
kept AS (SELECT DISTINCT snapshot_id FROM manifest ORDER BY snapshot_id DESC LIMIT 30)"""

_RUNS = """
runs AS (
  SELECT event_id, concat('job-', user_id) AS job,
         CASE user_id % 3 WHEN 0 THEN 'critical_etl' WHEN 1 THEN 'batch_migration'
                          ELSE 'analytical_workload' END AS sla_name,
         value * 40 AS duration_seconds,
         CASE WHEN event_type <> 'click' THEN event_id END AS output_count, user_id AS target_count,
         event_id * 1000 AS bytes_processed, event_type <> 'error' AS success, ts
  FROM events
),
samples AS (
  SELECT *, coalesce(output_count, target_count) / greatest(duration_seconds, 0.001) AS rows_per_second,
         bytes_processed / greatest(duration_seconds, 0.001) AS bytes_per_second
  FROM runs
)"""

_BAD = "transaction_id LIKE '%-7'"


def _rule(name: str, bad: str, passed: str, message: str) -> str:
    """One line of a rule report; ``bad`` counts violations over ``tx``."""
    return f"""
SELECT '{name}' AS rule, CAST(bad AS BIGINT) AS violations, CAST(n AS BIGINT) AS row_count,
       {passed} AS passed, {message} AS message
FROM (SELECT {bad} AS bad, count(*) AS n FROM tx)"""


def _null_count(column: str, damaged: bool = False) -> str:
    lost = f" OR {_BAD}" if damaged else ""
    return f"count(*) FILTER ({column} IS NULL{lost})"


def _null_rule(name: str, column: str, threshold: float, damaged: bool = False) -> str:
    return _rule(
        name,
        _null_count(column, damaged),
        f"bad / greatest(n, 1) <= {threshold}",
        f"printf('{column} null ratio %.4f', bad / greatest(n, 1))",
    )


_BALANCE = _rule(
    "balance_check",
    "count(*) FILTER (amount < 0 OR balance_after < 0)",
    "bad = 0",
    "concat(bad, ' rows with negative amount/balance')",
)
_UNIQUE = _rule(
    "transaction_consistency",
    "count(*) - count(DISTINCT transaction_id) - coalesce(max(CAST(transaction_id IS NULL AS INT)), 0)",
    "bad = 0",
    "concat('total=', n, ' distinct=', n - bad)",
)
_POSITIVE = _rule(
    "amount_positive", "count(*) FILTER (amount <= 0)", "bad = 0", "concat(bad, ' non-positive amount rows')"
)


def _with_tx(*selects: str) -> str:
    return f"WITH {_TX} " + " UNION ALL ".join(selects)


def _required(column: str, present: bool) -> str:
    return _rule(
        f"{column}_required",
        "0" if present else "1",
        "true" if present else "false",
        f"'{column} {'present' if present else 'missing'}'",
    )


_STANDARD_COLUMNS = [
    "transaction_id",
    "account_id",
    "customer_id",
    "transaction_type",
    "amount",
    "currency",
    "merchant_category",
    "channel",
    "transaction_ts",
    "status",
    "transaction_date",
]
_TX_COLUMNS = [
    "transaction_id",
    "account_id",
    "customer_id",
    "transaction_type",
    "amount",
    "currency",
    "merchant_name",
    "merchant_category",
    "channel",
    "transaction_ts",
    "branch_code",
    "status",
    "balance_after",
    "country_code",
]

_SUITE = [
    _null_rule("id_present", "transaction_id", 0),
    _null_rule("merchant_present", "merchant_name", 0.01, damaged=True),
    _POSITIVE,
    _rule(
        "status_known",
        "count(*) FILTER (status IS NULL OR status NOT IN ('SUCCESS', 'FAILED', 'PENDING'))",
        "bad = 0",
        "concat(bad, ' rows with invalid status values')",
    ),
    _BALANCE,
    _UNIQUE,
]

ORACLES: dict[str, str] = {
    "scan_parquet": _ORDERS_OUT,
    "scan_table": "SELECT * FROM part",
    "scan_formats": "SELECT *, unnest(['orc', 'json', 'csv']) AS fmt FROM customer",
    "parse_ts": f"""
        WITH {_TX}
        SELECT transaction_id,
               strftime(TRY_CAST(CASE WHEN {_BAD} THEN 'nope' ELSE CAST(transaction_ts AS VARCHAR) END AS TIMESTAMP),
                        '%Y-%m-%dT%H:%M:%S') AS transaction_ts,
               CAST(TRY_CAST(CASE WHEN {_BAD} THEN 'nope' ELSE CAST(transaction_ts AS VARCHAR) END AS DATE)
                    AS VARCHAR) AS transaction_date
        FROM tx""",
    "decimal_cast": f"""
        WITH {_TX}
        SELECT transaction_id,
               CAST(TRY_CAST(CASE WHEN {_BAD} THEN 'bad' ELSE CAST(amount AS VARCHAR) END AS DECIMAL(18,2))
                    AS DOUBLE) AS amount,
               CAST(TRY_CAST(CASE WHEN {_BAD} THEN '1e20' ELSE CAST(balance_after AS VARCHAR) END
                    AS DECIMAL(18,2)) AS DOUBLE) AS balance_after
        FROM tx""",
    "filter_status": f"WITH {_TX} SELECT transaction_id, status, amount FROM tx WHERE status = 'SUCCESS'",
    "filter_amount": f"""
        WITH {_TX}, cast_tx AS (
          SELECT transaction_id, status, CAST(CASE WHEN {_BAD} THEN 0.004 ELSE amount END AS DECIMAL(18,2)) AS amount
          FROM tx)
        SELECT transaction_id, status, CAST(amount AS DOUBLE) AS amount FROM cast_tx WHERE amount > 0""",
    "normalize_raw": f"""
        WITH {_TX}
        SELECT transaction_id, strftime(transaction_ts, '%Y-%m-%dT%H:%M:%S') AS transaction_ts,
               round(amount, 2) AS amount, round(balance_after, 2) AS balance_after
        FROM tx""",
    "bronze_enrich": f"WITH {_TX} "
    + _BRONZE.format(
        ts="strftime(transaction_ts, '%Y-%m-%d %H:%M:%S')", path="'lake://raw/transactions' AS source_path,"
    ),
    "bronze_to_silver": f"WITH {_SILVER} {_VALID_OUT} FROM silver",
    "dedup_keys": f"""
        WITH {_TX}, dated AS (SELECT *, CAST(transaction_ts AS DATE) AS transaction_date FROM tx)
        SELECT * REPLACE (strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') AS transaction_ts,
                          strftime(transaction_date, '%Y-%m-%d') AS transaction_date)
        FROM (
          SELECT * FROM dated
          QUALIFY row_number() OVER (
            PARTITION BY account_id, transaction_date
            ORDER BY transaction_ts DESC, transaction_id DESC, amount DESC, customer_id DESC, transaction_type DESC,
                     currency DESC, merchant_name DESC, merchant_category DESC, channel DESC, branch_code DESC,
                     status DESC, balance_after DESC, country_code DESC) = 1)""",
    "identity_copy": "SELECT * FROM customer",
    "gold_daily_report": f"WITH {_GOLD} {_GOLD_OUT}",
    "gold_incremental": f"WITH {_GOLD} {_GOLD_OUT}",
    "recent_report": f"""
        WITH {_GOLD}
        SELECT strftime(report_date, '%Y-%m-%d') AS report_date, merchant_category, channel, transaction_count,
               CAST(total_amount AS DOUBLE) AS total_amount
        FROM gold
        WHERE report_date >= (SELECT max(report_date) FROM gold) - INTERVAL 7 DAY
        ORDER BY total_amount DESC""",
    "row_count": "SELECT count(*) AS n FROM lineitem",
    "profile_nulls": f"WITH {_TX} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        f"{_null_count(c, c in ('amount', 'status', 'merchant_name'))} AS null_count, "
        f"count(*) AS row_count, {len(_TX_COLUMNS)} AS column_count FROM tx"
        for c in _TX_COLUMNS
    ),
    "schema_findings": f"""
        WITH {_TX}
        SELECT 'amount' AS column_name, 'type_mismatch' AS finding, count(*) FILTER ({_BAD}) AS rows, true AS passed
        FROM tx
        UNION ALL SELECT 'batch', 'extra', count(*) FILTER (NOT {_BAD}), true FROM tx
        UNION ALL SELECT 'channel', 'missing', count(*), false FROM tx
        UNION ALL SELECT 'currency', 'missing', count(*), false FROM tx""",
    "latest_k_per_group": """
        SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
        FROM events QUALIFY rn <= 5""",
    "latest_2000_per_group": """
        SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (
          PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn
        FROM lineitem QUALIFY rn <= 2000""",
    "reconcile_types": """
        SELECT pair, (SELECT count(*) FROM events) AS source_count, (SELECT count(*) FROM events) AS target_count,
               true AS counts_match, true AS checksum_match, true AS passed, 'row counts match' AS message
        FROM (VALUES ('wider'), ('text')) p(pair)""",
    "dq_not_null": _with_tx(
        _null_rule("amount_strict", "amount", 0, damaged=True), _null_rule("amount_lenient", "amount", 0.5, damaged=True)
    ),
    "dq_positive": _with_tx(
        _rule(
            "amount_positive",
            f"count(*) FILTER ({_BAD} OR amount <= 0)",
            "bad = 0",
            "concat(bad, ' non-positive amount rows')",
        )
    ),
    "dq_allowed": _with_tx(
        _rule(
            "status_allowed",
            f"count(*) FILTER ({_BAD} OR status NOT IN ('SUCCESS', 'FAILED'))",
            "bad = 0",
            "concat(bad, ' rows with invalid status values')",
        )
    ),
    "disallowed_values": f"""
        WITH {_TX}, damaged AS (SELECT CASE WHEN {_BAD} THEN NULL ELSE status END AS value FROM tx)
        SELECT DISTINCT value FROM damaged WHERE value IS NULL OR value NOT IN ('SUCCESS', 'FAILED')""",
    "br_balance": _with_tx(_BALANCE),
    "br_unique_id": _with_tx(_UNIQUE),
    "business_rules": _with_tx(_BALANCE, _UNIQUE),
    "quality_report": f"""
        WITH report AS ({_with_tx(*_SUITE)})
        SELECT 'transactions' AS table_name, row_count,
               count(*) FILTER (passed) OVER () / count(*) OVER () AS quality_score,
               rule, violations, passed, message
        FROM report""",
    "table_standard": _with_tx(
        *[_required(c, c != "channel") for c in _STANDARD_COLUMNS],
        _null_rule("transaction_id_not_null", "transaction_id", 0),
        _null_rule("account_id_not_null", "account_id", 0),
        _null_rule("amount_not_null", "amount", 0.01, damaged=True),
        _null_rule("transaction_ts_not_null", "transaction_ts", 0.01),
    ),
    "reconcile_counts": f"""
        WITH {_TX}, c AS (SELECT count(*) AS s, count(*) FILTER (NOT {_BAD}) AS t FROM tx)
        SELECT s AS source_count, t AS target_count, s = t AS passed,
               CASE WHEN s = t THEN 'row counts match' ELSE concat('mismatch source=', s, ' target=', t) END AS message
        FROM c""",
    "reconcile_content": f"""
        WITH {_TX}, a AS (SELECT transaction_id, account_id, amount FROM tx),
        b AS (SELECT transaction_id, account_id, CASE WHEN {_BAD} THEN NULL ELSE amount END AS amount FROM tx),
        d AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS n)
        SELECT 'reordered' AS pair, count(*) AS source_count, count(*) AS target_count, true AS counts_match,
               true AS checksum_match, true AS passed, 'row counts match' AS message FROM a
        UNION ALL
        SELECT 'changed', count(*), count(*), true, (SELECT n = 0 FROM d), (SELECT n = 0 FROM d),
               'row counts match' FROM b""",
    "batch_plan": f"""
        WITH {_FILES}
        SELECT path, length,
               CAST((sum(length) OVER (ORDER BY md5(path), path ROWS UNBOUNDED PRECEDING) - length)
                    // (2000 * 1024 * 1024) AS BIGINT) AS batch_id
        FROM files""",
    "batch_summary": f"""
        WITH {_FILES}, s AS (SELECT CAST(sum(length) AS BIGINT) AS total_size_bytes FROM files),
        b AS (SELECT total_size_bytes,
                     CAST(greatest(1, ceil(total_size_bytes / (2000 * 1024 * 1024))) AS BIGINT) AS batch_count FROM s)
        SELECT *, least(4, batch_count) AS recommended_parallelism FROM b""",
    "batches_to_retry": f"""
        WITH {_FILES}, {_ATTEMPTS}, open AS (
          SELECT f.batch_id, coalesce(attempts, 0) AS attempts
          FROM (SELECT DISTINCT batch_id FROM files) f LEFT JOIN state USING (batch_id)
          WHERE NOT coalesce(done, false))
        SELECT batch_id, attempts,
               CASE WHEN attempts = 0 THEN 'run' WHEN attempts < 3 THEN 'retry' ELSE 'dead' END AS action,
               CASE WHEN attempts >= 3 THEN 'max retries exceeded' END AS error
        FROM open""",
    "migration_progress": f"""
        WITH {_ATTEMPTS}, t AS (
          SELECT count(*) FILTER (done) AS completed_batches, count(*) FILTER (NOT done) AS failed_batches,
                 CAST(sum(row_count) AS BIGINT) AS total_rows,
                 CAST(sum(bytes_processed) AS BIGINT) AS processed_bytes
          FROM state)
        SELECT CAST(1000000 AS BIGINT) AS total_batches, completed_batches, failed_batches, total_rows,
               CAST(100000000000000 AS BIGINT) AS total_bytes, processed_bytes,
               processed_bytes / CAST(3600 AS DOUBLE) AS bytes_per_second,
               (100000000000000 - processed_bytes) / (processed_bytes / CAST(3600 AS DOUBLE)) AS seconds_left,
               true AS sla_at_risk
        FROM t""",
    "file_stats": f"""
        WITH {_LISTING}
        SELECT "table", count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_bytes,
               min(length) AS min_bytes, max(length) AS max_bytes, quantile_disc(length, 0.5) AS median_bytes
        FROM listing GROUP BY "table" """,
    "file_size_sketch": f"""
        WITH {_LISTING}, exact AS (
          SELECT "table", q AS quantile, count(*) AS file_count, CAST(sum(length) AS BIGINT) AS total_bytes,
                 CASE q WHEN 0.1 THEN quantile_disc(length, 0.1) WHEN 0.5 THEN quantile_disc(length, 0.5)
                        WHEN 0.9 THEN quantile_disc(length, 0.9) ELSE max(length) END AS size
          FROM listing, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(q) GROUP BY "table", q)
        SELECT "table", quantile, file_count, total_bytes,
               2 * pow(1.01 / 0.99, ceil(ln(size) / ln(1.01 / 0.99))) / (1.01 / 0.99 + 1) AS bytes
        FROM exact""",
    "maintenance_plan": f"""
        WITH {_LISTING}
        SELECT "table", file_count, {_PREDICTED},
               CASE WHEN file_count >= 100 THEN 'compact' ELSE 'none' END AS rewrite,
               file_count >= 100 AS expire_snapshots, file_count BETWEEN 50 AND 99 AS scheduled_later
        FROM stats""",
    "maintenance_hybrid": f"""
        WITH {_LISTING}
        SELECT "table", file_count, {_PREDICTED},
               CASE WHEN file_count >= 100 THEN 'sort' ELSE 'none' END AS rewrite,
               true AS expire_snapshots, false AS scheduled_later
        FROM stats""",
    "expired_snapshots": f"""
        WITH {_MANIFEST}
        SELECT DISTINCT snapshot_id, strftime(committed_at, '%Y-%m-%d %H:%M:%S') AS committed_at
        FROM manifest WHERE snapshot_id NOT IN (SELECT snapshot_id FROM kept)""",
    "expired_files": f"""
        WITH {_MANIFEST}
        SELECT DISTINCT path FROM manifest
        EXCEPT SELECT path FROM manifest WHERE snapshot_id IN (SELECT snapshot_id FROM kept)""",
    "orphan_files": f"""
        WITH {_MANIFEST}
        SELECT path, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS "modificationTime"
        FROM manifest GROUP BY path
        HAVING max(l_shipdate) < TIMESTAMP '2000-01-01' AND NOT bool_or(l_returnflag = 'R')""",
    "throughput": f"WITH {_RUNS} SELECT event_id, job, rows_per_second, bytes_per_second FROM samples",
    "latest_throughput": f"""
        WITH {_RUNS}
        SELECT job, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, rows_per_second, bytes_per_second FROM samples
        QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, rows_per_second DESC, bytes_per_second DESC) = 1""",
    "sla_compliance": f"""
        WITH {_RUNS}, sla(sla_name, max_s, min_rate) AS (
          VALUES ('critical_etl', 1800, 0.995), ('batch_migration', 14400, 0.99), ('analytical_workload', 7200, 0.98)),
        c AS (
          SELECT sla_name, min_rate, count(*) AS runs, count(*) FILTER (NOT success) AS failed,
                 count(*) FILTER (success AND duration_seconds > max_s) AS breaches,
                 count(*) FILTER (duration_seconds > CAST(0.8 AS DOUBLE) * max_s) AS at_risk,
                 count(*) FILTER (success AND duration_seconds <= max_s) AS compliant
          FROM runs JOIN sla USING (sla_name) GROUP BY ALL)
        SELECT sla_name, runs, failed, breaches, at_risk, compliant, (runs - failed) / runs AS success_rate,
               breaches = 0 AND (runs - failed) / runs >= min_rate AS sla_met
        FROM c""",
    "sla_unknown": f"""
        WITH {_RUNS}, sla(sla_name, max_s, min_rate) AS (
          VALUES ('critical_etl', 1800, 0.995), ('batch_migration', 14400, 0.99), ('analytical_workload', 7200, 0.98)),
        r AS (
          SELECT CASE event_type WHEN 'click' THEN 'nightly' WHEN 'error' THEN NULL ELSE runs.sla_name END AS sla_name,
                 success, duration_seconds FROM runs JOIN events USING (event_id)),
        c AS (
          SELECT r.sla_name, min_rate, count(*) AS runs, count(*) FILTER (NOT success) AS failed,
                 count(*) FILTER (success AND duration_seconds > max_s) AS breaches,
                 count(*) FILTER (duration_seconds > CAST(0.8 AS DOUBLE) * max_s) AS at_risk,
                 count(*) FILTER (success AND (max_s IS NULL OR duration_seconds <= max_s)) AS compliant
          FROM r LEFT JOIN sla ON r.sla_name = sla.sla_name GROUP BY r.sla_name, min_rate)
        SELECT sla_name, runs, failed, breaches, at_risk, compliant, (runs - failed) / runs AS success_rate,
               CASE WHEN min_rate IS NOT NULL THEN breaches = 0 AND (runs - failed) / runs >= min_rate END AS sla_met
        FROM c""",
    "quality_summary": """
        SELECT event_type AS sla_name, count(*) AS checks,
               round(avg(least(value / 100, 1.0)), 6) AS average_quality_score
        FROM events GROUP BY event_type""",
    "latest_checks": """
        SELECT event_type AS sla_name, CAST(least(value / 100, 1.0) AS DOUBLE) AS quality_score, event_id AS row_count,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
        FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)""",
    "synthetic_domains": """
        SELECT count(*) AS n, count(DISTINCT l_orderkey) AS n_ids, CAST(0 AS BIGINT) AS bad_amount,
               CAST(0 AS BIGINT) AS bad_balance, CAST(0 AS BIGINT) AS bad_type, CAST(0 AS BIGINT) AS bad_channel,
               CAST(0 AS BIGINT) AS bad_status, CAST(0 AS BIGINT) AS bad_ts, CAST(0 AS BIGINT) AS bad_account
        FROM lineitem""",
    "synthetic_learned_fit": f"""
        WITH {_TX}
        SELECT c AS "column", CASE WHEN c = 'transaction_id' THEN n_keys ELSE n END AS n, true AS nulls_fit, true AS shares_fit, CAST(0 AS BIGINT) AS unknown_values
        FROM (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys FROM lineitem),
             (SELECT unnest([
            'transaction_id', 'account_id', 'customer_id', 'transaction_type', 'amount', 'currency',
            'merchant_name', 'merchant_category', 'channel', 'transaction_ts', 'branch_code', 'status',
            'balance_after', 'country_code']) AS c)
        UNION ALL
        -- Pairs of the columns that correlate: all but the id and the columns of more than 1,000 values.
        SELECT 'correlations', k * (k - 1) // 2, true, true, CAST(0 AS BIGINT)
        FROM (SELECT 3 + CAST(len(list_filter([
            count(DISTINCT account_id), count(DISTINCT customer_id), count(DISTINCT transaction_type),
            count(DISTINCT currency), count(DISTINCT merchant_name), count(DISTINCT merchant_category),
            count(DISTINCT channel), count(DISTINCT branch_code), count(DISTINCT status),
            count(DISTINCT country_code)], lambda n: n <= 1000)) AS BIGINT) AS k FROM tx)""",
    "generated_json_lines": f"""WITH {_TX}
        SELECT *, true AS reached, true AS counted, CAST(0 AS BIGINT) AS foreign_rows
        FROM (SELECT 'transaction_type' AS "column", transaction_type AS value FROM tx
              UNION SELECT 'channel', channel FROM tx)""",
    "ingest_json": f"WITH {_TX} "
    + _BRONZE.format(ts="strftime(transaction_ts, '%Y-%m-%dT%H:%M:%S')", path=""),
    "medallion_report": f"WITH {_GOLD} {_GOLD_OUT}",
    "migrate_dataset": f"{_ORDERS_OUT} UNION ALL {_ORDERS_OUT}",
    "migrate_batched": _LINEITEM_OUT,
    "dedup_append": """
        SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate),
               CASE WHEN l_orderkey % 10 < 6 THEN 'first' ELSE 'second' END AS load
        FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
          l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, l_quantity DESC NULLS LAST,
          l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST, l_tax DESC NULLS LAST,
          l_returnflag DESC NULLS LAST, l_linestatus DESC NULLS LAST, l_shipdate DESC NULLS LAST) = 1""",
    "ingest_variant": """
        WITH e AS (
          SELECT *, event_id % 100 = 7 AS bad, coalesce(event_type = 'click', false) AS click FROM events)
        SELECT CASE WHEN NOT bad THEN event_id END AS event_id, CASE WHEN NOT bad THEN event_type END AS event_type,
               CASE WHEN NOT bad AND NOT click THEN value END AS value,
               CASE WHEN bad THEN NULL WHEN NOT click THEN '' WHEN user_id IS NULL THEN 'value' ELSE 'user_id,value' END
                 AS extra_fields,
               CASE WHEN NOT bad AND click THEN user_id END AS user_id,
               CASE WHEN NOT bad AND click THEN value END AS amount,
               CASE WHEN bad THEN CAST(event_id AS VARCHAR) END AS bad_event
        FROM e""",
    "reconcile_drilldown": """
        SELECT CASE WHEN o_orderkey % 1000 = 9 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS o_orderkey,
               CASE o_orderkey % 1000 WHEN 8 THEN 'missing' WHEN 9 THEN 'extra' ELSE 'changed' END AS status
        FROM orders WHERE o_orderkey % 1000 IN (7, 8, 9, 10)""",
    "migrate_batched_drift": """
        SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN value END AS value,
               CASE WHEN event_type <> 'click' THEN user_id END AS user_id
        FROM events WHERE event_type IS NOT NULL""",
    "ingest_quarantine": f"""
        WITH {_TX}, placed AS (SELECT CASE WHEN {_BAD} THEN 'bad' ELSE 'bronze' END AS place FROM tx)
        SELECT place, count(*) AS n FROM placed GROUP BY place""",
    "copy_deduplicated": f"""
        WITH {_TX}
        SELECT transaction_id, amount, strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') AS transaction_ts, merchant_name
        FROM tx
        QUALIFY row_number() OVER (
          PARTITION BY transaction_id ORDER BY amount DESC, tx.transaction_ts DESC, merchant_name DESC) = 1""",
    "compacted_table": f"{_ORDERS_OUT} UNION ALL {_ORDERS_OUT}",
    "sorted_table": _LINEITEM_OUT,
    "zorder_table": _LINEITEM_OUT,
    "orphans_of_a_crash": """
        SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'done' ELSE 'begun' END AS place, count(*) AS n
        FROM orders GROUP BY 1""",
    "stream_append": f"WITH {_VALID} {_VALID_OUT} FROM valid",
    "stream_silver": f"WITH {_SILVER} {_VALID_OUT} FROM silver",
    "stream_silver_damaged": f"""
        WITH {_SILVER} {_VALID_OUT.replace("strftime(transaction_ts", f"strftime(CASE WHEN NOT {_BAD} THEN transaction_ts END").replace("strftime(transaction_date", f"strftime(CASE WHEN NOT {_BAD} THEN transaction_date END")}
        FROM silver""",
    "stream_silver_newest": f"WITH {_SILVER} {_VALID_OUT} FROM silver",
    "stream_published": """
        SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events""",
    "hybrid_partitions": """
        SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events""",
    "hybrid_append": """
        SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts) FROM events""",
}
