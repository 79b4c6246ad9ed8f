"""Ledger, execution and notification queries over the derived tables.

An order is a run, its line items are legs and fills: return flags stand for the legs' results,
ship dates for times, discounts against tax for slippage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind import ledger
from crosswind.operators.asof import asof
from crosswind.plans.panel_queries import rd, text
from crosswind.sources.panels import run_sql

LEGS = """SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber = 7 THEN 'skipped_after_failure' ELSE ' Rejected' END ELSE 'filled' END AS status,
 CASE WHEN l_tax = 0.08 AND l_linenumber = 1 THEN 'late' ELSE '' END AS error FROM lineitem"""
RUNS = """SELECT o_orderkey % 2000 AS id, CAST(o_orderdate AS TIMESTAMP) + {step} AS ts, 'rebalance' AS kind, o_orderpriority AS strategy,
 CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'degraded' ELSE 'failed' END AS status, o_orderkey % 97 = 0 AS forced FROM orders"""
EQUITY = """SELECT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS TIMESTAMP) + {step} AS ts, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 1000, 2) END AS shadow_nav,
 CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * 1.01 / 1000, 2) END AS paper_equity, CAST(NULL AS STRING) AS note FROM orders"""
#: Rows of one key at different times: a microsecond for each order.
STEP = {"spark": "make_dt_interval(0, 0, 0, o_orderkey / 1000000.0)", "duckdb": "to_microseconds(o_orderkey)"}


def _of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sf_dir, sql.replace("{step}", STEP["spark"]))


def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's status as its legs show it."""
    return ledger.inferred_status(_of(spark, sf_dir, LEGS))


def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merged_runs(_of(spark, sf_dir, RUNS)).select("id", "strategy", "status")


def ledger_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.merged_equity(_of(spark, sf_dir, EQUITY)).select("d", "shadow_nav", "paper_equity", "drift_bps")


SEV = "CASE status WHEN 'failed' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END"
ORACLE = {
    "run_statuses": f"""SELECT run_id, CASE WHEN max(CASE WHEN lower(trim(status)) = 'skipped_after_failure' THEN 1 ELSE 0 END) = 1 THEN 'failed'
 WHEN max(CASE WHEN lower(trim(status)) IN ('rejected', 'skipped_after_failure') OR error <> '' THEN 1 ELSE 0 END) = 1 THEN 'degraded' ELSE 'ok' END AS status FROM ({LEGS}) z GROUP BY run_id""",
    "ledger_runs": f"""WITH r AS ({RUNS}), s AS (SELECT *, max(CASE WHEN forced THEN ts END) OVER (PARTITION BY id) AS since FROM r)
SELECT id, arg_min(strategy, ts) AS strategy, (SELECT arg_max(x.status, {SEV.replace('status', 'x.status')}) FROM s x WHERE x.id = s.id AND (x.since IS NULL OR x.ts >= x.since)) AS status FROM s GROUP BY id""".replace("{step}", STEP["duckdb"]),
    "ledger_equity": f"""WITH e AS ({EQUITY}), d AS (SELECT d, arg_max(shadow_nav, ts) FILTER (WHERE shadow_nav IS NOT NULL) AS n, arg_max(paper_equity, ts) FILTER (WHERE paper_equity IS NOT NULL) AS p FROM e GROUP BY d),
 b AS (SELECT d, n, p, lag(n) OVER (ORDER BY d) AS bn, lag(p) OVER (ORDER BY d) AS bp FROM d WHERE n IS NOT NULL AND p IS NOT NULL),
 c AS (SELECT d.d, d.n, d.p, (SELECT arg_max(row(b.n, b.p), b.d) FROM b WHERE b.d < d.d) AS q FROM d)
SELECT d, n AS shadow_nav, p AS paper_equity, round((p / struct_extract(q, 2) - n / struct_extract(q, 1)) * 10000, 2) + 0.0 AS drift_bps FROM c""".replace("{step}", STEP["duckdb"]).replace("AS STRING", "AS VARCHAR"),
}


def slippage_levels(d):
    """Fills by how far they are from their reference."""
    bps = "(l_tax - l_discount) * 1000"
    return f"""SELECT l_suppkey AS symbol, level, count(*) AS fills, {rd('avg(bps)', 4)} AS mean_bps, {rd('max(abs(bps))', 4)} AS worst_bps FROM
 (SELECT l_suppkey, round({bps}, 6) AS bps, CASE WHEN l_returnflag = 'N' THEN 'ok' WHEN round(abs({bps}), 6) >= 75 THEN 'critical' WHEN round(abs({bps}), 6) >= 25 THEN 'warning' ELSE 'ok' END AS level FROM lineitem) z GROUP BY l_suppkey, level"""


def reconcile_drift(d):
    """Held shares of the book against targets, and which are off by over a hundredth."""
    share = lambda x: f"SELECT symbol, q / total AS w FROM {x} CROSS JOIN (SELECT sum(q) AS total FROM {x}) z"
    return f"""WITH t AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), h AS (SELECT l_suppkey AS symbol, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus <> 'F' AND l_returnflag <> 'R' GROUP BY 1),
 w AS ({share('t')}), v AS ({share('h')}),
 j AS (SELECT coalesce(w.symbol, v.symbol) AS symbol, coalesce(w.w, 0) AS target, coalesce(v.w, 0) AS held FROM w FULL JOIN v ON v.symbol = w.symbol)
SELECT symbol, {rd('target')} AS target, {rd('held')} AS held, {rd('held - target')} AS drift, round(abs(held - target), 9) > 0.01 AS breach FROM j"""


def rebalance_gates(d):
    """What blocks a plan: stale data, missing prices or volumes, illiquid targets, gross over the cap."""
    return f"""WITH t AS (SELECT l_suppkey AS symbol, max(CAST(l_shipdate AS DATE)) AS last, avg(CASE WHEN l_quantity > 40 THEN l_extendedprice / l_quantity END) AS price, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS adv, count(*) AS n FROM lineitem GROUP BY 1),
 a AS (SELECT max(last) AS today FROM t), g AS (SELECT 'stale' AS gate, count(CASE WHEN {d.days('today', 'last')} > 5 THEN 1 END) AS n FROM t CROSS JOIN a
 UNION ALL SELECT 'missing_price', count(CASE WHEN price IS NULL THEN 1 END) FROM t UNION ALL SELECT 'missing_adv', count(CASE WHEN adv IS NULL THEN 1 END) FROM t UNION ALL SELECT 'illiquid', count(CASE WHEN adv < 5000000 THEN 1 END) FROM t)
SELECT gate, n, CASE WHEN n > 0 THEN 'BLOCK' ELSE 'PASS' END AS state FROM g"""


def notifications(d):
    """Events as (type, data, timestamp), control records apart."""
    k = "get_json_object(props, '$.k')" if d.spark else "json_extract_string(props, '$.k')"
    epoch = "unix_millis(CAST(ts AS TIMESTAMP))" if d.spark else "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
    return f"SELECT event_id, CASE WHEN event_type IN ('error', 'login') THEN 'control' ELSE event_type END AS type, CASE WHEN event_type NOT IN ('error', 'login') THEN CAST({k} AS BIGINT) END AS data, {epoch} AS millis FROM events"


def order_states(d):
    """Each user's last state and if it is final: a purchase or an error ends it."""
    last = d.by("max", "event_type", "struct(ts, event_id)" if d.spark else "row(ts, event_id)")
    return f"SELECT user_id AS order_id, {last} AS status, {last} IN ('purchase', 'error') AS done, count(*) AS notes FROM events GROUP BY user_id"


def position_pnl_ticks(d):
    """Value, unrealised gain and change over the day of each position at the newest mark of each hour."""
    hour = "date_trunc('hour', ts)"
    key = "struct(ts, event_id)" if d.spark else "row(ts, event_id)"
    return f"""WITH m AS (SELECT user_id AS symbol, {hour} AS hour, {d.by('max', 'value', key)} AS mark FROM events WHERE value > 0 GROUP BY 1, 2),
 q AS (SELECT symbol, hour, mark, first_value(mark) OVER (PARTITION BY symbol ORDER BY hour) AS cost, lag(mark) OVER (PARTITION BY symbol ORDER BY hour) AS before FROM m)
SELECT symbol, CAST(hour AS TIMESTAMP) AS hour, {rd('mark * (1 + symbol % 5)')} AS value, {rd('(mark - cost) * (1 + symbol % 5)')} AS unrealised, {rd('CASE WHEN before > 0 THEN mark / before - 1 END')} AS change FROM q"""


#: How long a quote stays in force, and the stretch of time that quotes are dealt by, in microseconds.
IN_FORCE, STRETCH = 6 * 3_600_000_000, 24 * 3_600_000_000


def fill_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as fills, each with the user's last view up to it as the price in force, and how far off it was."""
    events = run_sql(spark, sf_dir, "SELECT event_id, ts, user_id, event_type, value FROM events")
    quotes = events.where("event_type = 'view' AND value > 0").select("user_id", "ts", F.col("value").alias("price"), F.col("event_id").alias("quote_id"))
    got = asof(events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value"), quotes, "user_id", "ts", ["price", "quote_id"], STRETCH, IN_FORCE, tie="quote_id")
    return got.select("event_id", "user_id", "quote_id", F.round("price", 6).alias("price"), (F.round((F.col("value") / F.col("price") - 1) * 1e4, 4) + F.lit(0.0)).alias("slippage_bps"))


ORACLE["fill_reference"] = f"""WITH q AS (SELECT user_id, ts, max(event_id) AS quote_id FROM events WHERE event_type = 'view' AND value > 0 GROUP BY user_id, ts),
 v AS (SELECT q.*, e.value AS price FROM q JOIN events e ON e.event_id = q.quote_id), j AS (SELECT f.event_id, f.user_id, f.value, v.quote_id, v.price, date_diff('microsecond', v.ts, f.ts) AS age FROM (SELECT * FROM events WHERE event_type = 'purchase') f ASOF LEFT JOIN v ON v.user_id = f.user_id AND v.ts <= f.ts)
SELECT event_id, user_id, CASE WHEN age <= {IN_FORCE} THEN quote_id END AS quote_id, CASE WHEN age <= {IN_FORCE} THEN round(price, 6) END AS price, CASE WHEN age <= {IN_FORCE} THEN round((value / price - 1) * 10000, 4) + 0.0 END AS slippage_bps FROM j"""


SQL = {f.__name__: f for f in (slippage_levels, reconcile_drift, rebalance_gates, notifications, order_states, position_pnl_ticks)}


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"))

    return {n: one(f) for n, f in SQL.items()} | {f.__name__: f for f in (run_statuses, ledger_runs, ledger_equity, fill_reference)}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()} | ORACLE
