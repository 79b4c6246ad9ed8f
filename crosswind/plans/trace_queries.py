"""Why a candidate was chosen: queries over the newest board of six strategies, with SQL written apart, and over all boards of the registry's replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.operators import trace
from crosswind.operators.strategies import STRATEGIES
from crosswind.plans import board_queries, strategy_queries
from crosswind.plans.panel_queries import Dialect, ctes, growth, text
from crosswind.sources.panels import run_sql
from crosswind.sources.shared import keyed, signature

#: Drawdowns that set and clear a strategy's latch, and dates of the deepest recent drawdown.
SET, CLEAR, RECENT = 0.15, 0.10, 252
NEWEST, HISTORY = ["as_of"], ["policy", "date"]


_OWN = "PARTITION BY strategy ORDER BY date"
#: When each strategy's latch last went on and off, by its P&L ``bp``.
LATCH = (
    ("tn", f"SELECT strategy, date, {growth('net', _OWN)} AS nav FROM bp"), ("td", f"SELECT *, 1 - nav / max(nav) OVER ({_OWN} ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS fall FROM tn"),
    ("te", f"SELECT strategy, max(CASE WHEN fall > {SET} THEN date END) AS went, max(CASE WHEN fall < {CLEAR} THEN date END) AS came, max(date) AS as_of FROM td GROUP BY strategy"),
)
#: The newest board, the date it is of, and whether each candidate's latch is on.
LATCHED = """ SELECT te.as_of, b.candidate, b.strategy, b.action, b.alpha, b.net_alpha, b.cost, b.turn_penalty, b.risk_penalty, b.utility, b.turnover, b.overlap, b.vol, b.dd, b.required,
 CASE WHEN b.action = 'rebalance' THEN te.went IS NOT NULL AND (te.came IS NULL OR te.went > te.came) ELSE false END AS kill, b.eligible AND NOT CASE WHEN b.action = 'rebalance' THEN te.went IS NOT NULL AND (te.came IS NULL OR te.went > te.came) ELSE false END AS eligible
 FROM bd b JOIN te ON te.strategy = b.strategy"""


def _latched(d) -> str:
    return ctes(d, *board_queries.board(d), *LATCH) + LATCHED


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest board of six strategies, kept once for all queries on it; holds and cadences aren't known there."""
    books = board_queries.kept_books(spark, sf_dir)
    rest = text(lambda d: "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in (*board_queries.board(d), *LATCH)) + LATCHED, "spark")
    sign = signature(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")], repr(board_queries.books(Dialect("spark"))), rest)
    got = keyed(spark, lambda: run_sql(spark, sf_dir, rest, **books), f"newest-board-{sign}")
    unknown = F.lit(None).cast("boolean")
    return got.withColumn("hold_lock", unknown).withColumn("cadence_due", unknown)


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boards of the replay: candidates as they were measured, a row that holds, and which was chosen (``planned``)."""

    def make() -> DataFrame:
        rows, made = strategy_queries._replayed(spark, sf_dir, True), strategy_queries._replayed(spark, sf_dir, False)
        own = Window.partitionBy("strategy_id").orderBy("date").rowsBetween(1 - RECENT, 0)
        nav = strategy_queries.strategy_pnl(spark, sf_dir).selectExpr("strategy_id", "date", "vol", f"{growth('net_ret', 'PARTITION BY strategy_id ORDER BY date')} AS nav")
        risk = nav.withColumn("fall", 1 - F.col("nav") / F.max("nav").over(own)).select("strategy_id", "date", "vol", F.max("fall").over(own).alias("dd"))
        price = F.element_at(F.create_map(*[F.lit(v) for p in strategy_queries.POLICIES for v in (p.name, p.turnover_penalty)]), F.col("policy"))
        turn = F.col("turnover") * price
        own_rows = rows.join(risk, ["strategy_id", "date"], "left").join(made.select("policy", "date", F.when(F.col("action") == "rebalance", F.col("held")).alias("to")), ["policy", "date"]).select(
            "policy", "date", F.col("strategy_id").alias("candidate"), F.col("strategy_id").alias("strategy"), F.lit("rebalance").alias("action"), "alpha", "net_alpha", "cost", turn.alias("turn_penalty"),
            (F.col("net_alpha") - F.col("utility") - turn).alias("risk_penalty"), "utility", "turnover", F.lit(None).cast("double").alias("overlap"), "vol", "dd", "eligible", "required", "cadence_due", "hold_lock", "kill", (F.col("to") == F.col("strategy_id")).alias("planned"),
        )
        zero, was = F.lit(0.0), F.lag("held").over(Window.partitionBy("policy").orderBy("date"))
        holds = made.select(
            "policy", "date", F.lit(trace.HOLD).alias("candidate"), was.alias("strategy"), F.lit("hold").alias("action"), F.col("hold_utility").alias("alpha"), F.col("hold_utility").alias("net_alpha"), zero.alias("cost"), zero.alias("turn_penalty"),
            zero.alias("risk_penalty"), F.col("hold_utility").alias("utility"), zero.alias("turnover"), F.lit(1.0).alias("overlap"), zero.alias("vol"), zero.alias("dd"), F.lit(True).alias("eligible"), F.lit(None).cast("boolean").alias("required"),
            F.lit(None).cast("boolean").alias("cadence_due"), F.lit(None).cast("boolean").alias("hold_lock"), F.lit(None).cast("boolean").alias("kill"), (F.col("action") == "hold").alias("planned"),
        ).where("strategy IS NOT NULL")
        return own_rows.unionByName(holds)

    tables = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")]
    return keyed(spark, make, f"trace-boards-{signature(spark, tables, repr(STRATEGIES), repr(strategy_queries.POLICIES), str(RECENT))}")


def visible_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft regime that the newest board shows."""
    return trace.regimes(newest(spark, sf_dir), NEWEST)


def decision_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate of the newest board's candidates."""
    return trace.nodes(newest(spark, sf_dir), NEWEST)


def play_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge, flags, risk points, conviction and the call of the newest board's candidates."""
    return trace.scorecard(newest(spark, sf_dir), NEWEST)


def decision_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates a decision on the newest board may name, and why not the others."""
    return trace.rails(newest(spark, sf_dir), NEWEST)


def choice_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest board's focus less its best alternatives."""
    return trace.explained(newest(spark, sf_dir), NEWEST)


def regime_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The soft regime of all boards of the replay, by policy and date."""
    return trace.regimes(boards(spark, sf_dir), HISTORY)


def node_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each gate passed, warned and blocked, by policy, strategy and gate, over all dates."""
    every = trace.nodes(boards(spark, sf_dir), HISTORY)
    return every.groupBy("policy", "candidate", "node").agg(F.count(F.lit(1)).alias("dates"), *[F.count(F.when(F.col("state") == s, 1)).alias(s.lower()) for s in ("PASS", "WARN", "BLOCK")])


def play_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scorecards of all boards of the replay, by policy, date and candidate."""
    return trace.scorecard(boards(spark, sf_dir), HISTORY)


def choice_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was chosen at each date less its best alternatives."""
    return trace.explained(boards(spark, sf_dir), HISTORY, planned="planned")


def frontier_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each board of the replay, which of the registry's strategies it lacks, and whether a decision could be made on it."""
    every = boards(spark, sf_dir)
    return trace.frontier(every, HISTORY, list(STRATEGIES)).join(trace.readiness(every, HISTORY), HISTORY)


def book_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross, net, positions, effective number and top weights of every strategy's book on every date."""
    return trace.provenance(strategy_queries.strategy_books(spark, sf_dir).select("strategy_id", "date", "asset", "weight"), ["strategy_id", "date"])


def queries() -> dict:
    return {f.__name__: f for f in (visible_regime, decision_nodes, play_scorecard, decision_rails, choice_explained, regime_history, node_history, play_history, choice_history, frontier_history, book_provenance)}


def oracle_sql() -> dict[str, str]:
    """Over the board's SQL, each by hand: regimes by exponentials, gates as a union, places by counting the rows before, alternatives by joins."""
    board = f"WITH b0 AS ({text(_latched, 'duckdb')}), b AS (SELECT * REPLACE (round(utility, 9) AS utility, round(turnover, 9) AS turnover, round(alpha, 9) AS alpha, round(net_alpha, 9) AS net_alpha, round(cost, 9) AS cost, round(turn_penalty, 9) AS turn_penalty, round(risk_penalty, 9) AS risk_penalty, round(overlap, 9) AS overlap, round(vol, 9) AS vol, round(dd, 9) AS dd) FROM b0)"
    soft = lambda x, s: f"(1 - 2 / (exp(2 * {x} / {s}) + 1))"
    regime = f""", n AS (SELECT as_of, count(*) AS candidates, sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS able FROM b GROUP BY as_of),
 m AS (SELECT b.as_of, avg(utility) AS u, avg(alpha) AS a, avg(turnover) AS t, avg(risk_penalty) AS r, avg(dd) AS d, avg(vol) AS v FROM b JOIN n ON n.as_of = b.as_of WHERE eligible OR able = 0 GROUP BY b.as_of),
 s AS (SELECT *, greatest(0.01e0, 0.5e0 + 0.2e0 * {soft('u', '8e0')} + 0.15e0 * {soft('a', '10e0')}) AS s1, greatest(0.01e0, 0.25e0 + 0.2e0 * {soft('r', '10e0')} + 0.2e0 * {soft('d', '0.1e0')}) AS s2,
 greatest(0.01e0, 0.2e0 + 0.2e0 * {soft('t', '0.25e0')} - 0.1e0 * {soft('u', '8e0')}) AS s3, greatest(0.01e0, 0.15e0 + 0.2e0 * {soft('v', '0.2e0')}) AS s4 FROM m),
 q AS (SELECT *, round(s1 / (s1 + s2 + s3 + s4), 4) AS risk_on, round(s2 / (s1 + s2 + s3 + s4), 4) AS risk_off, round(s3 / (s1 + s2 + s3 + s4), 4) AS chop, round(s4 / (s1 + s2 + s3 + s4), 4) AS ops_stress FROM s),
 z AS (SELECT as_of, name AS state FROM (UNPIVOT (SELECT as_of, risk_on, risk_off, chop, ops_stress FROM q) ON risk_on, risk_off, chop, ops_stress INTO NAME name VALUE p) y QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY p DESC, list_position(['risk_on', 'risk_off', 'chop', 'ops_stress'], name)) = 1)
SELECT q.as_of, n.candidates, CAST(n.able AS BIGINT) AS able, false AS stale, round(a, 4) + 0.0 AS mean_alpha, round(d, 4) + 0.0 AS mean_dd, round(r, 4) + 0.0 AS mean_risk_penalty, round(t, 4) + 0.0 AS mean_turnover, round(u, 4) + 0.0 AS mean_utility, round(v, 4) + 0.0 AS mean_vol, risk_on, risk_off, chop, ops_stress, z.state
 FROM q JOIN n ON n.as_of = q.as_of JOIN z ON z.as_of = q.as_of"""
    gates = """ SELECT as_of, candidate, 'eligible' AS node, CASE WHEN eligible THEN 'PASS' ELSE 'BLOCK' END AS state, CAST(NULL AS DOUBLE) AS value FROM b
 UNION ALL SELECT as_of, candidate, 'required', CASE WHEN required THEN 'PASS' ELSE 'BLOCK' END, NULL FROM b UNION ALL SELECT as_of, candidate, 'kill', CASE WHEN kill THEN 'BLOCK' ELSE 'PASS' END, NULL FROM b
 UNION ALL SELECT as_of, candidate, 'turnover', CASE WHEN turnover > 0.35e0 THEN 'BLOCK' ELSE 'PASS' END, round(turnover, 5) + 0.0 FROM b UNION ALL SELECT as_of, candidate, 'utility', CASE WHEN utility < 0 THEN 'WARN' ELSE 'PASS' END, round(utility, 3) + 0.0 FROM b"""
    card = """, h AS (SELECT as_of, utility AS hold FROM b WHERE candidate = 'hold_current'),
 f AS (SELECT b.*, round(utility - hold, 9) AS edge, list_filter([CASE WHEN kill THEN 'kill switch' END, CASE WHEN turnover > 0.35e0 THEN 'high turnover' END, CASE WHEN dd > 0.15e0 THEN 'drawdown risk' END, CASE WHEN vol > 0.35e0 THEN 'high vol' END,
 CASE WHEN overlap < 0.25e0 AND action = 'rebalance' THEN 'low overlap' END, CASE WHEN NOT required AND action <> 'hold' THEN 'rebalance not required' END], lambda x: x IS NOT NULL) AS fl FROM b JOIN h ON h.as_of = b.as_of),
 p AS (SELECT *, round(35e0 * turnover + 25e0 * abs(dd) + 20e0 * vol + 0.2e0 * cost + 4 * len(fl), 2) AS points, CASE WHEN candidate = 'hold_current' THEN 4 WHEN kill OR NOT eligible THEN 5 WHEN edge >= 2 AND len(fl) = 0 THEN 1 WHEN edge >= 0 THEN 2 ELSE 3 END AS c FROM f),
 k AS (SELECT *, round(edge - 0.05e0 * points, 6) AS conviction FROM p),
 o AS (SELECT x.as_of, x.candidate, 1 + count(y.candidate) AS place FROM k x LEFT JOIN k y ON y.as_of = x.as_of AND (y.c < x.c OR y.c = x.c AND (y.conviction > x.conviction OR y.conviction = x.conviction AND (y.utility > x.utility OR y.utility = x.utility AND y.candidate < x.candidate))) GROUP BY 1, 2)
SELECT k.as_of, CAST(o.place AS INT) AS place, k.candidate, k.strategy, ['GREENLIGHT', 'REVIEW', 'HOLD CURRENT', 'HOLD BASELINE', 'BLOCK'][c] AS call, eligible, round(edge, 3) + 0.0 AS edge, round(utility, 3) + 0.0 AS utility, round(net_alpha, 3) + 0.0 AS net_alpha, round(cost, 3) + 0.0 AS cost,
 points + 0.0 AS risk_points, round(conviction, 3) + 0.0 AS conviction, CASE WHEN len(fl) = 0 THEN 'clear' ELSE array_to_string(fl, ', ') END AS flags, o.place = 1 AS best FROM k JOIN o ON o.as_of = k.as_of AND o.candidate = k.candidate"""
    said = "concat_ws(', ', CASE WHEN NOT required THEN 'rebalance not required' END, CASE WHEN kill THEN 'kill switch' END, CASE WHEN turnover > 0.35e0 THEN 'turnover over the limit' END)"
    rails = f" SELECT as_of, candidate, eligible AS allowed, CASE WHEN eligible THEN '' WHEN {said} = '' THEN 'not eligible under the policy' ELSE {said} END AS reasons FROM b"
    less = ("utility", "alpha", "net_alpha", "cost", "turn_penalty", "risk_penalty", "turnover", "overlap")
    choice = f""", g AS (SELECT as_of, coalesce(max(CASE WHEN eligible AND action = 'rebalance' THEN utility END), 0) AS most, bool_or(eligible AND action = 'rebalance') AS moves FROM b GROUP BY as_of),
 f AS (SELECT b.as_of, min(candidate) AS focus FROM b JOIN g ON g.as_of = b.as_of WHERE CASE WHEN moves THEN eligible AND action = 'rebalance' AND utility = most ELSE candidate = 'hold_current' END GROUP BY b.as_of),
 w AS (SELECT b.*, f.focus FROM b JOIN f ON f.as_of = b.as_of AND f.focus = b.candidate), x AS (SELECT b.*, row_number() OVER (PARTITION BY b.as_of ORDER BY b.utility DESC, b.candidate) AS place FROM b JOIN f ON f.as_of = b.as_of AND f.focus <> b.candidate)
SELECT x.as_of, w.focus, CAST(x.place AS INT) AS place, x.candidate, x.action, x.eligible, CASE WHEN x.eligible AND x.required AND NOT x.kill AND x.turnover <= 0.35e0 THEN 'eligible alternative' ELSE concat_ws(', ', CASE WHEN NOT x.eligible THEN 'not eligible' END, {said[16:].replace('required THEN', 'x.required THEN').replace('WHEN kill', 'WHEN x.kill').replace('WHEN turnover', 'WHEN x.turnover')} END AS against,
 {', '.join(f'round(w.{c} - x.{c}, 5) + 0.0 AS d_{c}' for c in less)} FROM x JOIN w ON w.as_of = x.as_of WHERE x.place <= 8"""
    return {"visible_regime": board + regime, "decision_nodes": board + gates, "play_scorecard": board + card, "decision_rails": board + rails, "choice_explained": board + choice}
