"""Universe, calendar and coercion queries over the derived tables.

Orders stand in for index changes: a customer's number modulo 60 is a symbol, the order's date the
effective date and its priority the action; symbols whose customers have a high mean balance are in the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.plans.panel_queries import Dialect, rd, text
from crosswind.sources import store, universe
from crosswind.sources.calendar import calendar_ctes
from crosswind.sources.panels import bars_sql, run_sql

AS_OF = "1999-06-30"
EVENTS = """SELECT CAST(o_orderdate AS DATE) AS effective_date, concat('S', CAST(o_custkey % 60 AS STRING)) AS symbol,
 CASE WHEN min(o_orderpriority) < '3' THEN 'add' ELSE 'remove' END AS action FROM orders GROUP BY 1, 2"""
SEED = "SELECT concat('S', CAST(c_custkey % 60 AS STRING)) AS symbol FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4500"
DATES = "SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS date FROM orders"


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(run_sql(spark, sf_dir, q) for q in (SEED, EVENTS, DATES))


def index_change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed, events, _ = _given(spark, sf_dir)
    return universe.audited(seed, events, F.lit(AS_OF).cast("date")).select("effective_date", "symbol", "action", "status")


def universe_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed, events, _ = _given(spark, sf_dir)
    return universe.symbols_as_of(seed, events, F.lit(AS_OF).cast("date"))


def membership_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed, events, dates = _given(spark, sf_dir)
    return universe.membership(dates, seed, events, F.lit(AS_OF).cast("date")).select("date", "symbol", F.col("member").cast("int").alias("member"))


def min_days_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed, events, dates = _given(spark, sf_dir)
    return universe.listed_long(universe.membership(dates, seed, events, F.lit(AS_OF).cast("date")), 150)


def _bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(run_sql(spark, sf_dir, f"SELECT date, asset, c AS close FROM ({bars_sql('spark').replace('WHERE l_quantity > 0', 'WHERE l_quantity > 0' + more)}) z") for more in (" AND l_linestatus = 'F'", ""))


def restated_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose closes changed as later lines came."""
    old, fresh = _bars(spark, sf_dir)
    return store.restated(old, fresh).select("asset", (F.round("worst", 6) + F.lit(0.0)).alias("worst"))


def nation_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the closes of done lines and of all lines are apart."""
    old, fresh = _bars(spark, sf_dir)
    return store.parity(old, fresh).select("only_a", "only_b", "common", (F.round("median_worst", 6) + F.lit(0.0)).alias("median_worst"), "over_tolerance")


def _sql(*ctes: tuple[str, str]) -> str:
    every = (("seed", SEED), ("ev", EVENTS), ("dates", DATES), *ctes)
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in every).replace("AS STRING", "AS VARCHAR") + "\n"


DUE = f"effective_date <= DATE '{AS_OF}'"
MEMBERS = (
    ("due", f"SELECT symbol, action, effective_date, (SELECT min(date) FROM dates WHERE date >= e.effective_date) AS date FROM ev e WHERE {DUE}"),
    ("moved", "SELECT symbol, date, arg_max(action, row(effective_date, action)) AS action FROM due WHERE date IS NOT NULL GROUP BY symbol, date"),
    ("sy", "SELECT symbol FROM seed UNION SELECT symbol FROM moved"),
    ("mem", "SELECT d.date, s.symbol, coalesce((SELECT arg_max(m.action, m.date) = 'add' FROM moved m WHERE m.symbol = s.symbol AND m.date <= d.date), s.symbol IN (SELECT symbol FROM seed)) AS member FROM dates d CROSS JOIN sy s"),
)
TWO = "WITH a AS (SELECT date, asset, c AS close FROM (" + bars_sql("duckdb").replace("WHERE l_quantity > 0", "WHERE l_quantity > 0 AND l_linestatus = 'F'") + ") x), b AS (SELECT date, asset, c AS close FROM (" + bars_sql("duckdb") + ") x), j AS (SELECT asset, max(abs(a.close - b.close) / (abs(a.close) + 1e-9)) AS worst, count(*) AS n FROM a JOIN b USING (date, asset) GROUP BY asset) "
ORACLE = {
    "restated_nations": TWO + "SELECT asset, round(worst, 6) + 0.0 AS worst FROM j WHERE n >= 2 AND worst > 0.002",
    "nation_parity": TWO + """SELECT (SELECT count(*) FROM (SELECT asset FROM a EXCEPT SELECT asset FROM b) z) AS only_a, (SELECT count(*) FROM (SELECT asset FROM b EXCEPT SELECT asset FROM a) z) AS only_b, count(*) AS common, round(median(worst), 6) + 0.0 AS median_worst, CAST(sum(CASE WHEN worst > 0.005 THEN 1 ELSE 0 END) AS BIGINT) AS over_tolerance FROM j""",
    "index_change_audit": _sql(("b", f"SELECT *, lag(CASE WHEN {DUE} THEN action END) OVER (PARTITION BY symbol ORDER BY effective_date, action) AS last FROM ev"),
                               ("p", "SELECT *, CASE WHEN last IS NOT NULL THEN last = 'add' ELSE symbol IN (SELECT symbol FROM seed) END AS before FROM b"))
    + f"SELECT effective_date, symbol, action, CASE WHEN NOT ({DUE}) THEN 'pending' WHEN action = 'add' THEN CASE WHEN before THEN 'noop_present' ELSE 'applied' END WHEN before THEN 'applied' ELSE 'noop_absent' END AS status FROM p",
    "universe_as_of": _sql(("l", f"SELECT symbol, arg_max(action, row(effective_date, action)) AS action FROM ev WHERE {DUE} GROUP BY symbol"))
    + "SELECT symbol FROM (SELECT symbol FROM seed UNION SELECT symbol FROM l) z WHERE coalesce((SELECT action = 'add' FROM l WHERE l.symbol = z.symbol), true)",
    "membership_matrix": _sql(*MEMBERS) + "SELECT date, symbol, CAST(member AS INT) AS member FROM mem",
    "min_days_listed": _sql(*MEMBERS) + "SELECT symbol FROM mem WHERE member GROUP BY symbol HAVING count(*) >= 150",
}


def market_calendar(d):
    return f"WITH {calendar_ctes(d, '2019-01-01', '2027-12-31')} SELECT d, w, trading FROM cal"


def trading_days_since(d):
    """Trading days after each order's day up to a date: 0 for later orders."""
    return f"""WITH {calendar_ctes(d, '1991-12-01', '2002-01-31')}, n AS (SELECT d, sum(trading) OVER (ORDER BY d) AS k FROM cal),
 o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
 SELECT o.o_orderkey, CASE WHEN o.day >= DATE '{AS_OF}' THEN 0 ELSE (SELECT max(k) FROM n WHERE d = DATE '{AS_OF}') - n.k END AS days FROM o JOIN n ON n.d = o.day"""


def coercion(d):
    """Numbers and truth values from text, null or false where there is none."""
    json = "get_json_object(props, '$.k')" if d.spark else "json_extract_string(props, '$.k')"
    mixed = f"CASE event_id % 4 WHEN 0 THEN {json} WHEN 1 THEN concat(event_type, '') WHEN 2 THEN ' Yes ' ELSE 'on' END"
    kind = "STRING" if d.spark else "VARCHAR"
    return f"SELECT event_id, try_cast(x AS DOUBLE) AS number, coalesce(lower(trim(x)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS truth, substr({'sha2(x, 256)' if d.spark else 'sha256(x)'}, 1, 16) AS digest FROM (SELECT event_id, CAST({mixed} AS {kind}) AS x FROM events) z"


def unpivoted(d):
    """Bars as (date, asset, field, value) rows: melt, one pass over the panel."""
    fields = ("o", "h", "l", "c", "v")
    from crosswind.plans.panel_queries import ctes

    if d.spark:
        return ctes(d) + f"SELECT date, asset, field, {rd('value')} AS value FROM (SELECT date, asset, stack(5, {', '.join(f"'{f}', {f}" for f in fields)}) AS (field, value) FROM panel) z WHERE value IS NOT NULL"
    return ctes(d) + " UNION ALL ".join(f"SELECT date, asset, '{f}' AS field, {rd(f)} AS value FROM panel WHERE {f} IS NOT NULL" for f in fields)


def traded_assets(d):
    """Suppliers that have a line item of 50 units without discount: left-semi."""
    return "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount < 0.005)"


SQL = {f.__name__: f for f in (market_calendar, trading_days_since, coercion, unpivoted, traded_assets)}


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"))

    return {n: one(f) for n, f in SQL.items()} | {f.__name__: f for f in (index_change_audit, universe_as_of, membership_matrix, min_days_listed, restated_nations, nation_parity)}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()} | ORACLE
