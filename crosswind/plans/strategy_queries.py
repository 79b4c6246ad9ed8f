"""All strategies of the registry in one plan: shared factors, reliability weights, scores, books, P&L, and the choice among them by date.

Factors are computed once for all strategies and kept under a signature of their definitions and the tables' files; a strategy
is a column of a sparse matrix of weights, so that a date's scores of all strategies are one product of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.operators import construct, cross, pnl, selection
from crosswind.operators.strategies import BLENDS, STRATEGIES, factor_rows
from crosswind.operators.factors import REGISTRY
from crosswind.plans.blend_ctes import share_ctes
from crosswind.plans.factor_queries import scores
from crosswind.plans.meta_queries import base, learned, values
from crosswind.plans.panel_queries import EPS, P, Dialect, ctes, growth, text
from crosswind.plans.risk_queries import ewm_ctes
from crosswind.sources.panels import run_sql
from crosswind.sources.shared import keyed, signature

#: The horizon of reliability, the least cross-section, and of expected alpha the half-life, history and mixture.
HORIZON, LEAST, HALFLIFE, HISTORY = 21, 15, 63, 42
POLICIES = [selection.Policy(), selection.Policy("patient", switch=6.0, turnover_penalty=6.0)]


def _sql(spark: SparkSession, parts, tail: str, **frames: DataFrame) -> DataFrame:
    """A statement over given frames alone."""
    body = text(lambda _: "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" + tail, "spark")
    for n in frames:
        body = body.replace(f"@{n}", "{" + n + "}")
    return spark.sql(body, **frames)


def panel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, asset, ret, fwd, liquid, cap_mult) of the derived panel."""
    d = Dialect("spark")
    more = (("ag", f"SELECT date, asset, count(c) {P} AS age FROM panel"), ("f21", f"SELECT date, asset, fwd FROM fwd WHERE h = {HORIZON}"))
    tail = """SELECT r.date, r.asset, r.ret, f.fwd, CASE WHEN e.ok THEN 1.0 ELSE 0.0 END AS liquid, 0.25 + 0.75 * least(1.0, ag.age / 63.0) AS cap_mult
 FROM r JOIN elig e ON e.date = r.date AND e.asset = r.asset JOIN ag ON ag.date = r.date AND ag.asset = r.asset LEFT JOIN f21 f ON f.date = r.date AND f.asset = r.asset"""
    return run_sql(spark, sf_dir, text(lambda _: ctes(d, *base(d), *more) + tail, "spark"))


def weights_by_date(spark: SparkSession, wide: DataFrame, panel: DataFrame) -> DataFrame:
    """(grp, factor, date, weight): each strategy's reliability weights of its factors.

    Coefficients are one table of factors and dates that all strategies share, redundancy one of strategies and factors.
    """
    d = Dialect("spark")
    ics = cross.rank_coefficients(wide.join(panel.select("date", "asset", "fwd"), ["date", "asset"]), list(REGISTRY), ["fwd"], LEAST)
    same = cross.redundancy(wide, {s.name: list(s.factors) for s in STRATEGIES.values()}, LEAST)
    spec = values([(s, f, HORIZON, int(REGISTRY[f].proven)) for s, f in factor_rows()])
    parts = [
        ("spec", f"SELECT * FROM (VALUES {spec}) AS t(grp, factor, h, proven)"), ("many", "SELECT date, CAST(sum(liquid) AS BIGINT) AS n FROM @panel GROUP BY date"),
        ("f_raw", "SELECT s.grp, s.h, s.factor, i.date, i.ic, i.n FROM spec s JOIN @ics i ON i.factor = s.factor"),
        ("f_pe", "SELECT grp, CAST(21 AS INT) AS h, factor, date, 1 - 0.3 * (1 - greatest(0.25, least(1.0, 1 - coalesce(mean_corr, 0)))) AS penalty FROM @same"),
        *[(n, q) for n, q in learned(d, "f", "none", "spec", 0.95, 0.30, 0.012, 0.25) if n not in ("f_met", "f_rk", "f_raw", "f_pr", "f_pe")],
    ]
    return _sql(spark, parts, "SELECT grp, factor, date, weight FROM f_w", panel=panel, ics=ics, same=same)


def combined(wide: DataFrame, weights: DataFrame) -> DataFrame:
    """(strategy_id, date, asset, score): weighted scores over the weights whose scores are there, 0 without any; one product of matrices a date."""
    names = list(REGISTRY)
    place = {n: i for i, n in enumerate(names)}

    def one(rows: pa.Table, own: pa.Table) -> pa.Table:
        groups, at = np.unique(own.column("grp").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        w = np.zeros((len(names), len(groups)))
        w[[place[f] for f in own.column("factor").to_pylist()], at] = own.column("weight").to_numpy()
        x = np.stack([rows.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
        known = np.isfinite(x)
        mass = known @ np.maximum(w, 0.0)
        score = np.where(mass > 1e-12, (np.where(known, x, 0.0) @ w) / np.maximum(mass, 1e-12), 0.0)
        n, k = score.shape
        return pa.table({"strategy_id": np.tile(groups, n).astype(object), "date": rows.column("date").combine_chunks().take(np.repeat(np.arange(n), k)), "asset": np.repeat(rows.column("asset").to_numpy(), k), "score": score.ravel()})

    kinds = dict(wide.dtypes)
    return wide.groupBy("date").cogroup(weights.select(F.col("date").alias("of"), "grp", "factor", "weight").groupBy("of")).applyInArrow(one, f"strategy_id string, date {kinds['date']}, asset {kinds['asset']}, score double")


def _kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make`` gives, once for each registry and set of files."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")]
    return keyed(spark, make, f"{name}-{signature(spark, tables, repr(STRATEGIES), repr(BLENDS), name)}")


def strategy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all strategies by date and asset."""

    def make() -> DataFrame:
        wide, panel = scores(spark, sf_dir, tuple(REGISTRY)), _kept(spark, sf_dir, "panel-rows", lambda: panel_rows(spark, sf_dir))
        return combined(wide, weights_by_date(spark, wide, panel))

    return _kept(spark, sf_dir, "strategy-scores", make)


def strategy_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of all strategies, each by its own parameters."""

    def make() -> DataFrame:
        panel = _kept(spark, sf_dir, "panel-rows", lambda: panel_rows(spark, sf_dir))
        rows = strategy_scores(spark, sf_dir).join(panel.select("date", "asset", "ret", "liquid", "cap_mult"), ["date", "asset"])
        return construct.unit_weights(rows, {s.name: s.book for s in STRATEGIES.values()})

    return _kept(spark, sf_dir, "strategy-books", make)


def strategy_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P&L of all strategies at their own costs, and the latch of each: on at a drawdown of 15 % until it is under 10 %."""

    def make() -> DataFrame:
        panel = _kept(spark, sf_dir, "panel-rows", lambda: panel_rows(spark, sf_dir))
        bps = F.element_at(F.create_map(*[F.lit(v) for s in STRATEGIES.values() for v in (s.name, s.bps)]), F.col("strategy_id"))
        made = pnl.backtest(strategy_books(spark, sf_dir).select("strategy_id", "date", "asset", "weight"), panel.select("date", "asset", "ret"), "strategy_id", bps)
        own = "PARTITION BY strategy_id ORDER BY date"
        parts = (
            ("nv", f"SELECT *, {growth('net_ret', own)} AS nav FROM @made"), ("dd", f"SELECT *, 1 - nav / max(nav) OVER ({own} ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS dd FROM nv"),
            ("ev", f"SELECT *, count(CASE WHEN dd > 0.15 OR dd < 0.10 THEN 1 END) OVER ({own}) AS k FROM dd"),
        )
        tail = f"SELECT strategy_id, date, gross_ret, tc, cash_yield, net_ret, turnover, gross_exposure, coalesce(max(CASE WHEN dd > 0.15 THEN 1 WHEN dd < 0.10 THEN 0 END) OVER (PARTITION BY strategy_id, k), 0) AS kill, CASE WHEN count(net_ret) OVER ({own} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) > 1 THEN stddev_samp(net_ret) OVER ({own} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) * sqrt(252.0) END AS vol FROM ev"
        return _sql(spark, parts, tail, made=made)

    return _kept(spark, sf_dir, "strategy-pnl", make)


def strategy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy_id, date, pos, alpha, vol, kill): expected alpha in basis points from what was known before each date.

    Slopes of the next return on scores, through the origin, and active returns, both smoothed; the slope is worth what the book's tilt makes of it.
    Kept, as boards and history replay the same facts.
    """
    return _kept(spark, sf_dir, "strategy-facts", lambda: _facts(spark, sf_dir))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _kept(spark, sf_dir, "panel-rows", lambda: panel_rows(spark, sf_dir))
    d, decay, own = Dialect("spark"), 1 - 0.5 ** (1 / HALFLIFE), "PARTITION BY strategy_id ORDER BY date"
    parts = (
        ("nx", f"SELECT date, asset, lead(ret, 1) {P} AS nxt FROM @panel"), ("mk", "SELECT date, coalesce(avg(ret), 0) AS mkt FROM @panel GROUP BY date"),
        ("sl", f"SELECT s.strategy_id, s.date, sum(s.score * n.nxt) / (sum(s.score * s.score) + {EPS}) AS slope FROM @scores s JOIN nx n ON n.date = s.date AND n.asset = s.asset WHERE n.nxt IS NOT NULL GROUP BY s.strategy_id, s.date"),
        ("ti", "SELECT b.strategy_id, b.date, sum(b.weight * s.score) AS tilt FROM @books b JOIN @scores s ON s.strategy_id = b.strategy_id AND s.date = b.date AND s.asset = b.asset GROUP BY b.strategy_id, b.date"),
        ("al", "SELECT p.strategy_id, p.date, p.vol, p.kill, p.net_ret - m.mkt AS active, sl.slope, coalesce(ti.tilt, 0) AS tilt FROM @pnl p JOIN mk m ON m.date = p.date LEFT JOIN sl ON sl.strategy_id = p.strategy_id AND sl.date = p.date LEFT JOIN ti ON ti.strategy_id = p.strategy_id AND ti.date = p.date"),
        *ewm_ctes(d, "al", "ae", decay, {"ms": "slope", "ma": "active"}, "strategy_id"),
        ("lg", f"SELECT *, lag(ms) OVER ({own}) AS s, lag(ma) OVER ({own}) AS a, count(slope) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n, row_number() OVER ({own}) - 1 AS pos FROM ae"),
    )
    tail = f"""SELECT strategy_id, date, CAST(pos AS BIGINT) AS pos, 10000 * greatest(-0.01, least(0.01, least(1.0, n / {2.0 * HISTORY}) * CASE WHEN n >= {HISTORY} THEN 0.70 * s * tilt + 0.30 * a ELSE 0.0 END)) AS alpha, vol, kill FROM lg"""
    return _sql(spark, parts, tail, panel=panel, scores=strategy_scores(spark, sf_dir), books=strategy_books(spark, sf_dir), pnl=strategy_pnl(spark, sf_dir))


def _replayed(spark: SparkSession, sf_dir: str, boards: bool) -> DataFrame:
    return selection.replay(strategy_facts(spark, sf_dir), strategy_books(spark, sf_dir).select("strategy_id", "date", "asset", "weight"), selection.traits_of(STRATEGIES.values()), POLICIES, boards)


def selection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy held, date by date, and why."""
    got = _replayed(spark, sf_dir, False)
    return got.select("policy", "date", "action", "held", "reason", F.round("turnover", 5).alias("turnover"), F.round("hold_utility", 3).alias("hold_utility"), "held_days", "eligible")


def selection_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each date's candidates under each policy, with costs, utility and gates."""
    got = _replayed(spark, sf_dir, True)
    return got.select("policy", "date", "strategy_id", *[F.round(c, k).alias(c) for c, k in (("alpha", 3), ("turnover", 5), ("change", 5), ("cost", 3), ("net_alpha", 3), ("utility", 3))], "same", "hold_lock", "cadence_due", "required", "kill", "eligible", "held_days")


def strategy_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six blends: shares, netted books costed anew, and whether a part of them is stopped."""
    made, books = strategy_pnl(spark, sf_dir), strategy_books(spark, sf_dir).select("strategy_id", "date", "asset", "weight")
    parts = [("np", "SELECT strategy_id, date, net_ret AS net FROM @made"), *share_ctes(Dialect("spark"), "np", list(BLENDS.values()))]
    shares = _kept(spark, sf_dir, "blend-shares", lambda: _sql(spark, parts, "SELECT blend, date, strategy_id, share FROM shares", made=made))
    panel = _kept(spark, sf_dir, "panel-rows", lambda: panel_rows(spark, sf_dir))
    got = pnl.backtest(construct.blended(books, shares), panel.select("date", "asset", "ret"), "blend")
    return got.join(construct.blended_kill(made.select("strategy_id", "date", "kill"), shares), ["blend", "date"], "left").select("blend", "date", *[F.round(c, 6).alias(c) for c in ("net_ret", "tc", "turnover", "gross_exposure")], F.coalesce("kill", F.lit(0)).alias("kill"))


def queries() -> dict:
    return {f.__name__: f for f in (strategy_scores, strategy_books, strategy_pnl, selection_history, selection_boards, strategy_blends)}


def oracle_sql() -> dict[str, str]:
    return {}
