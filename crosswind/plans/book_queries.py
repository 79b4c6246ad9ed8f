"""Books, blends, transitions, learned scores and knob scans over the derived panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.operators import construct, pnl, walkforward
from crosswind.plans.blend_ctes import share_ctes
from crosswind.plans.board_queries import STRATEGIES, books
from crosswind.plans.meta_queries import base, long_scores
from crosswind.plans.panel_queries import EPS, P, QUERIES, RETS, Dialect, ctes, growth, rd, text
from crosswind.sources.panels import run_sql
from crosswind.sources.shared import keyed, signature, stored

#: Blends of the registered strategies, one of each method.
BLENDS = (
    construct.Blend("steady", (("inv_vol", 0.7), ("resid_mom", 0.3))),
    construct.Blend("balanced", (("inv_vol", 0.25), ("mom_accel", 0.25), ("srev", 0.25), ("ou_zscore", 0.25)), "inverse_vol", least=0.1, most=0.5),
    construct.Blend("tilted", (("resid_mom", 0.4), ("srev", 0.3), ("vol_breakout", 0.3)), "alpha_risk", least=0.08, most=0.5, alpha=0.4),
)


def _rows(d) -> str:
    cap = "0.25 + 0.75 * least(1.0, age / 63.0)"
    return ctes(d, *base(d), *long_scores(d, list(STRATEGIES)), ("ag", f"SELECT date, asset, count(c) {P} AS age FROM panel")) + f"""SELECT s.factor AS strategy_id, s.date, s.asset, s.score, r.ret, CASE WHEN e.ok THEN 1.0 ELSE 0.0 END AS liquid, {cap} AS cap_mult
 FROM scores s JOIN r ON r.date = s.date AND r.asset = s.asset JOIN elig e ON e.date = s.date AND e.asset = s.asset JOIN ag ON ag.date = s.date AND ag.asset = s.asset"""


def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept once for the tables' files, as seats, targets and dates are all made of these rows."""
    sql = text(_rows, "spark")
    return keyed(spark, lambda: run_sql(spark, sf_dir, sql), f"unit-rows-{signature(spark, [f'{sf_dir}/{t}.parquet' for t in ('lineitem', 'supplier')], sql)}")


def unit_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit books of six strategies, with blended risk parity."""
    return construct.unit_weights(unit_rows(spark, sf_dir), construct.Book(seats=16, least_seats=10, most_seats=20, mode="blend"))


def _books(d) -> str:
    return ctes(d, *books(d)) + "SELECT strategy AS strategy_id, date, asset, w AS weight, net FROM (SELECT b.strategy, b.date, b.asset, b.w, p.net FROM bk b JOIN bp p ON p.strategy = b.strategy AND p.date = b.date) z"


def _shares(d, source: str) -> str:
    """Shares from the relation ``source`` (strategy_id, date, asset, weight, net)."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in (("bpnl", f"SELECT strategy_id, date, max(net) AS net FROM {source} GROUP BY strategy_id, date"), *share_ctes(d, "bpnl", BLENDS))) + "\n"


def blend_history(d, source: str):
    """Shares of the blends' parts by date."""
    return _shares(d, source) + f"SELECT blend, date, strategy_id, {rd('share', 7)} AS share FROM shares"


def blend_book(d, source: str):
    """The netted book of each blend."""
    return _shares(d, source) + f"SELECT s.blend, s.date, b.asset, {rd('sum(b.weight * s.share)', 7)} AS weight FROM shares s JOIN {source} b ON b.strategy_id = s.strategy_id AND b.date = s.date WHERE b.weight > 0 GROUP BY s.blend, s.date, b.asset"


def _of_books(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """A statement over the stored books of the strategies: two statements, as one would be too deep to resolve."""
    given = stored(spark, run_sql(spark, sf_dir, text(_books, "spark")), "books")
    return run_sql(spark, sf_dir, text(lambda d: f(d, "made"), "spark"), made=given)


def blend_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each blend's own P&L: costs of the netted book, not of its parts."""
    weights = _of_books(spark, sf_dir, blend_book)
    returns = run_sql(spark, sf_dir, text(lambda d: ctes(d, RETS) + "SELECT date, asset, ret FROM r", "spark"))
    got = pnl.backtest(weights, returns, "blend")
    return got.select("blend", "date", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in got.columns[2:]])


def of_books_sql(f) -> str:
    d = Dialect("duckdb")
    return f"WITH made AS ({_books(d)}) SELECT * FROM ({f(d, 'made')}) y"


def blend_pnl_sql() -> str:
    more = (
        ("bb", "SELECT * FROM (" + of_books_sql(blend_book) + ") z"),
        ("g", "SELECT n.blend, r.date, r.asset, r.ret, coalesce(b.weight, 0) AS w FROM r CROSS JOIN (SELECT DISTINCT blend FROM bb) n LEFT JOIN bb b ON b.blend = n.blend AND b.date = r.date AND b.asset = r.asset"),
        ("h", "SELECT *, lag(w) OVER (PARTITION BY blend, asset ORDER BY date) AS was FROM g"),
        ("k", "SELECT blend, date, coalesce(sum(was * ret), 0) AS gross_ret, coalesce(sum(abs(w - was)), 0) AS turnover, coalesce(sum(abs(was)), 0) AS gross_exposure FROM h GROUP BY blend, date"),
        ("c", "SELECT *, turnover * 3 / 10000 AS tc, greatest(0, 1 - gross_exposure) * 0.04 / 252 AS cash_yield FROM k"),
    )
    return ctes(Dialect("duckdb"), RETS, *more) + "SELECT blend, date, round(gross_ret, 6) + 0.0 AS gross_ret, round(tc, 6) + 0.0 AS tc, round(cash_yield, 6) + 0.0 AS cash_yield, round(gross_ret - tc + cash_yield, 6) + 0.0 AS net_ret, round(turnover, 6) + 0.0 AS turnover, round(gross_exposure, 6) + 0.0 AS gross_exposure FROM c"


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the six strategies earned, at what risk, and how they went with the market."""
    rows = run_sql(spark, sf_dir, text(lambda d: ctes(d, *books(d)) + "SELECT strategy, date, net, mkt AS bench FROM bp", "spark"))
    got = pnl.performance(rows, "strategy")
    return got.select("strategy", "days", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in got.columns[3:]])


def _performance_sql() -> str:
    """By products and sorted values."""
    d = Dialect("duckdb")
    year = lambda x: f"CASE WHEN min(1 + {x}) <= 0 THEN -1 ELSE pow(product(1 + {x}), 252.0 / count({x})) - 1 END"
    up, down = ("avg(net) FILTER (WHERE mkt > 0) / (avg(mkt) FILTER (WHERE mkt > 0) + 1e-12)", "avg(net) FILTER (WHERE mkt < 0) / (avg(mkt) FILTER (WHERE mkt < 0) - 1e-12)")
    columns = {
        "ann_return": year("net"), "ann_vol": "stddev_samp(net) * sqrt(252)", "sharpe": "avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252)", "sortino": "avg(net) / (stddev_samp(net) FILTER (WHERE net < 0) + 1e-12) * sqrt(252)", "max_dd": "min(dd)",
        "calmar": f"({year('net')}) / (abs(min(dd)) + 1e-12)", "win_rate": "avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)", "worst_day": "min(net)", "best_day": "max(net)", "skew": "skewness(net)", "kurtosis": "kurtosis(net)",
        "tail_ratio": "abs(quantile_cont(net, 0.95)) / (abs(quantile_cont(net, 0.05)) + 1e-12)", "active_return": year("(net - mkt)"), "active_vol": "stddev_samp(net - mkt) * sqrt(252)", "info_ratio": "avg(net - mkt) / (stddev_samp(net - mkt) + 1e-12) * sqrt(252)",
        "bench_return": year("mkt"), "beta": "regr_slope(net, mkt)", "alpha": "regr_intercept(net, mkt) * 252", "correlation": "corr(net, mkt)", "up_capture": up, "down_capture": down, "capture_spread": f"{up} - {down}",
    }
    more = (("kn", "SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY date) AS nav FROM bp WHERE net IS NOT NULL"), ("kd", "SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM kn"))
    return ctes(d, *books(d), *more) + "SELECT strategy, count(*) AS days, " + ", ".join(f"round({x}, 4) + 0.0 AS {c}" for c, x in columns.items()) + " FROM kd GROUP BY strategy"


#: Costs in basis points that the walk-forward report is run at.
KNOBS = {"BASE": 3.0, "cheap": 1.0, "dear": 6.0}


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, text(lambda d: ctes(d, *books(d)) + "SELECT strategy, date, sum(coalesce(prior * ret, 0)) AS gross, coalesce(sum(abs(w - prior)), 0) AS turnover FROM bk GROUP BY strategy, date", "spark"))
    return walkforward.folds(rows, KNOBS)


def walkforward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy's years at three costs: what it had shown before them, and what it did."""
    got = _walk(spark, sf_dir)
    places = {"train_sharpe": 4, "test_net": 6, "test_sharpe": 4, "test_max_dd": 6}
    return got.select("knob", "fold", "strategy", "train_days", "test_days", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in places.items()], "picked")


def walkforward_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What picking by the years before would have given, and if it hangs on the costs."""
    got = walkforward.verdicts(_walk(spark, sf_dir), "BASE")
    places = {"profitable": 4, "worst_net": 6, "least_sharpe": 4, "median_sharpe": 4}
    return got.select("knob", "folds", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in places.items()], "verdict")


def _walk_sql() -> str:
    """Folds by joining every date to every year that it is trained for, and compounding by products."""
    d = Dialect("duckdb")
    knobs = ", ".join(f"('{k}', {v})" for k, v in KNOBS.items())
    more = (
        ("g", "SELECT strategy, date, sum(coalesce(prior * ret, 0)) AS gross, coalesce(sum(abs(w - prior)), 0) AS turnover FROM bk GROUP BY strategy, date"),
        ("n", f"SELECT g.strategy, g.date, k.knob, year(g.date) AS y, g.gross - g.turnover * k.bps / 10000 AS net FROM g CROSS JOIN (VALUES {knobs}) k(knob, bps)"),
        ("o", "SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM g) z"), ("f", "SELECT year(date) AS fold, min(pos) AS first FROM o GROUP BY 1 HAVING count(*) >= 40"),
        ("tr", "SELECT n.strategy, n.knob, f.fold, count(*) AS train_days, avg(n.net) / (stddev_samp(n.net) + 1e-12) * sqrt(252) AS train_sharpe FROM n JOIN o ON o.date = n.date JOIN f ON o.pos < f.first - 21 GROUP BY 1, 2, 3 HAVING count(*) >= 40"),
        ("v", "SELECT n.*, product(1 + net) OVER (PARTITION BY strategy, knob, y ORDER BY date) AS nav FROM n WHERE y IN (SELECT fold FROM f)"),
        ("te", "SELECT strategy, knob, y AS fold, count(*) AS test_days, arg_max(nav, date) - 1 AS test_net, avg(net) / (stddev_samp(net) + 1e-12) * sqrt(252) AS test_sharpe, max(1 - nav / greatest(1, peak)) AS test_max_dd FROM (SELECT *, max(nav) OVER (PARTITION BY strategy, knob, y ORDER BY date) AS peak FROM v) z GROUP BY 1, 2, 3"),
        ("wf", "SELECT te.*, tr.train_days, tr.train_sharpe, tr.train_sharpe IS NOT NULL AND row_number() OVER (PARTITION BY te.knob, te.fold ORDER BY round(tr.train_sharpe, 9) DESC NULLS LAST, te.strategy) = 1 AS picked FROM te LEFT JOIN tr ON tr.strategy = te.strategy AND tr.knob = te.knob AND tr.fold = te.fold"),
    )
    return ctes(d, *books(d), *more)


WALK_SQL = {
    "walkforward_report": lambda: _walk_sql() + "SELECT knob, fold, strategy, train_days, test_days, round(train_sharpe, 4) + 0.0 AS train_sharpe, round(test_net, 6) + 0.0 AS test_net, round(test_sharpe, 4) + 0.0 AS test_sharpe, round(test_max_dd, 6) + 0.0 AS test_max_dd, picked FROM wf",
    "walkforward_verdict": lambda: _walk_sql() + """, p AS (SELECT knob, count(*) AS folds, avg(CASE WHEN test_net > 0 THEN 1.0 ELSE 0.0 END) AS profitable, min(test_net) AS worst_net, min(test_sharpe) AS least_sharpe, median(test_sharpe) AS median_sharpe FROM wf WHERE picked GROUP BY knob),
 b AS (SELECT max(CASE WHEN knob = 'BASE' THEN median_sharpe END) AS base, min(CASE WHEN knob <> 'BASE' THEN median_sharpe END) AS lo, max(CASE WHEN knob <> 'BASE' THEN median_sharpe END) AS hi FROM p)
SELECT knob, folds, round(profitable, 4) + 0.0 AS profitable, round(worst_net, 6) + 0.0 AS worst_net, round(least_sharpe, 4) + 0.0 AS least_sharpe, round(median_sharpe, 4) + 0.0 AS median_sharpe, CASE WHEN (base > 0 AND lo < 0.25 * base) OR hi - lo > greatest(1, abs(base)) THEN 'FRAGILE' ELSE 'ROBUST' END AS verdict FROM p CROSS JOIN b""",
}


def markov_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition matrix of the five return states, its stationary shares, dwell times, entropy and five-step forecast."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((5, 5))
        counts[frame["state"], frame["nxt"]] = frame["n"]
        m = construct.markov(counts)
        at = [(i, j) for i in range(5) for j in range(5)]
        wide = {k: [m[v][i, j] for i, j in at] for k, v in (("chance", "matrix"), ("forecast", "forecast"))}
        return pd.DataFrame({"state": [i for i, _ in at], "nxt": [j for _, j in at]} | wide | {k: [m[k][i] for i, _ in at] for k in ("stationary", "dwell", "entropy")})

    counted = run_sql(spark, sf_dir, text(QUERIES["markov_counts"], "spark"))  # at most 25 rows
    got = counted.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(one, "state int, nxt int, chance double, forecast double, stationary double, dwell double, entropy double")
    return got.withColumn("dwell", F.when(~F.isnan("dwell"), F.col("dwell")))


def sensitivity_scan(d):
    """The book's Sharpe ratio and drawdown at perturbed knobs: a knob is a group key, so all runs are one plan."""
    grid = [("BASE", 8, 3.0, 1), ("seats", 5, 3.0, 1), ("seats", 12, 3.0, 1), ("cost", 8, 1.0, 1), ("cost", 8, 6.0, 1), ("delay", 8, 3.0, 2), ("delay", 8, 3.0, 3)]
    vals = ", ".join(f"('{k}', {s}, {c!r}, {w})" for k, s, c, w in grid)
    own = "PARTITION BY knob, seats, tc, wait"
    return ctes(d, *books(d)[:4], ("gr", f"SELECT * FROM (VALUES {vals}) AS t(knob, seats, tc, wait)"),
        ("bk1", f"SELECT g.knob, g.seats, g.tc, g.wait, s.date, s.asset, r.ret, CASE WHEN s.seat <= g.seats THEN 1.0 / g.seats ELSE 0.0 END AS w FROM seat s JOIN r ON r.date = s.date AND r.asset = s.asset CROSS JOIN gr g WHERE s.strategy = 'srev'"),
        ("bk2", "SELECT *, CASE wait " + " ".join(f"WHEN {k} THEN lag(w, {k}) OVER ({own}, asset ORDER BY date)" for k in (1, 2, 3)) + f" END AS held, lag(w, 1) OVER ({own}, asset ORDER BY date) AS before FROM bk1"),
        ("pn", "SELECT knob, seats, tc, wait, date, sum(coalesce(held * ret, 0)) - coalesce(sum(abs(w - before)), 0) * tc / 10000 AS net FROM bk2 GROUP BY knob, seats, tc, wait, date"),
        ("nv", f"SELECT *, {growth('net', own + ' ORDER BY date')} AS nav FROM pn"), ("pk", f"SELECT *, max(nav) OVER ({own} ORDER BY date) AS peak FROM nv"),
        ("sh", f"SELECT knob, seats, tc, wait, avg(net) / (stddev_samp(net) + {EPS}) * sqrt(252.0) AS sharpe, max(1 - nav / peak) AS dd FROM pk GROUP BY knob, seats, tc, wait"),
        ("bs", "SELECT sharpe AS base FROM sh WHERE knob = 'BASE'"),
        ("vd", "SELECT CASE WHEN (max(base) > 0 AND min(CASE WHEN knob <> 'BASE' THEN sharpe END) < 0.25 * max(base)) OR max(CASE WHEN knob <> 'BASE' THEN sharpe END) - min(CASE WHEN knob <> 'BASE' THEN sharpe END) > greatest(1.0, abs(max(base))) THEN 'FRAGILE' ELSE 'ROBUST' END AS verdict FROM sh CROSS JOIN bs"),
    ) + f"SELECT knob, seats, {rd('tc')} AS tc, wait, {rd('sharpe', 4)} AS sharpe, {rd('dd', 4)} AS max_dd, {rd('sharpe - base', 3)} AS d_sharpe, verdict FROM sh CROSS JOIN bs CROSS JOIN vd"


SQL = {f.__name__: f for f in (sensitivity_scan,)}
OF_BOOKS = {f.__name__: f for f in (blend_history, blend_book)}


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"))

    def two(f):
        return lambda spark, sf_dir: _of_books(spark, sf_dir, f)

    return {n: one(f) for n, f in SQL.items()} | {n: two(f) for n, f in OF_BOOKS.items()} | {f.__name__: f for f in (unit_book, blend_pnl, performance, walkforward_report, walkforward_verdict, markov_regime)}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()} | {n: of_books_sql(f) for n, f in OF_BOOKS.items()} | {"blend_pnl": blend_pnl_sql(), "performance": _performance_sql()} | {n: f() for n, f in WALK_SQL.items()}
