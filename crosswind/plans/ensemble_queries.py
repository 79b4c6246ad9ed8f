"""The ensemble over all factors: four sleeves of factors by horizon, a learned sleeve, weights after stress, and cold starts.

Coefficients and redundancy come from whole cross-sections (``operators.cross``); the learner's rules are those of ``meta_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.functions.expr import staged
from crosswind.operators import cross, regime
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.plans import cross_queries, strategy_queries
from crosswind.plans.factor_queries import scores
from crosswind.plans.meta_queries import base, composed, learned, values
from crosswind.plans.panel_queries import EPS, MARKET, P, RETS, Dialect, _book, ctes, rd, text
from crosswind.plans.risk_queries import budget_ctes, drawdown_ctes, regime_signals
from crosswind.sources.panels import run_sql

# A sleeve's horizons, its sensitivity to stress, and if it keeps a floor.
SLEEVES = {"momentum": ((21, 63), -0.60, 1), "defensive": ((21,), 0.80, 1), "meanrev": ((5, 21), 0.40, 1), "micro": ((5, 21), 0.20, 1), "ml": ((21,), 0.0, 0)}
# Fixed values of a cold start: days before any score and until full, least part of the factors, least cap, window and least days of the range volatility, and its least cap.
COLD = {"days": 10, "full": 63, "coverage": 0.10, "cap": 0.25, "window": 21, "least": 5, "floor": 0.50}
HORIZONS, LEAST = (5, 21, 63), 15


def members() -> dict[str, list[str]]:
    return {s: sorted(n for n, f in REGISTRY.items() if f.sleeve == s) for s in SLEEVES}


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, asset, f5, f21, f63): forward returns of liquid assets."""
    cells = ", ".join(f"max(CASE WHEN h = {h} THEN fwd END) AS f{h}" for h in HORIZONS)
    return run_sql(spark, sf_dir, text(lambda _: ctes(Dialect("spark"), *base(Dialect("spark"))) + f"SELECT date, asset, {cells} FROM fwd GROUP BY date, asset", "spark"))


def learned_weights(spark: SparkSession, wide: DataFrame, targets: DataFrame, many: DataFrame, spec: list[tuple], groups: dict[str, list[str]], lam: float, strength: float, floor: float) -> DataFrame:
    """(grp, h, factor, date, weight) of ``spec`` rows (grp, factor, h, proven) by the learner's rules."""
    names = sorted({n for own in groups.values() for n in own})
    ics = cross.rank_coefficients(wide.join(targets, ["date", "asset"]), names, [f"f{h}" for h in sorted({r[2] for r in spec})], LEAST)
    same = cross.redundancy(wide, groups, LEAST)
    replaced = {"f_met", "f_rk", "f_raw", "f_pr", "f_pe"}
    parts = [
        ("spec", f"SELECT * FROM (VALUES {values(spec)}) AS t(grp, factor, h, proven)"), ("many", "SELECT * FROM @many"),
        ("f_raw", "SELECT s.grp, s.h, s.factor, i.date, i.ic, i.n FROM spec s JOIN @ics i ON i.factor = s.factor AND i.target = concat('f', s.h)"),
        ("f_pe", f"SELECT DISTINCT s.grp, s.h, s.factor, p.date, 1 - {strength} * (1 - greatest(0.25, least(1.0, 1 - coalesce(p.mean_corr, 0)))) AS penalty FROM spec s JOIN @same p ON p.grp = s.grp AND p.factor = s.factor"),
        *[(n, q) for n, q in learned(Dialect("spark"), "f", "none", "spec", lam, strength, floor, 0.25) if n not in replaced],
    ]
    return strategy_queries._sql(spark, parts, "SELECT grp, h, factor, date, weight FROM f_w", many=many, ics=ics, same=same)


def all_sleeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, asset, factor, score): each sleeve's score, averaged over its horizons; the learned sleeve is the boosted score."""

    def make() -> DataFrame:
        wide, own = scores(spark, sf_dir, tuple(REGISTRY)), {s: n for s, n in members().items() if n}
        many = run_sql(spark, sf_dir, text(lambda _: ctes(Dialect("spark"), *base(Dialect("spark"))) + "SELECT * FROM many", "spark"))
        spec = [(s, n, h, int(REGISTRY[n].proven)) for s, names in own.items() for n in names for h in SLEEVES[s][0]]
        w = learned_weights(spark, wide, _targets(spark, sf_dir), many, spec, own, 0.95, 0.30, 0.012)
        each = strategy_queries.combined(wide, w.select(F.concat_ws("|", "grp", "h").alias("grp"), "factor", "date", "weight"))
        factors = each.groupBy("date", "asset", F.substring_index("strategy_id", "|", 1).alias("factor")).agg(F.avg("score").alias("score"))
        dates = run_sql(spark, sf_dir, text(lambda _: ctes(Dialect("spark")) + "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel) z", "spark"))
        ml = cross_queries.ml_score(spark, sf_dir).join(dates, "pos").select("date", "asset", F.lit("ml").alias("factor"), "score")
        return factors.unionByName(ml)

    return strategy_queries._kept(spark, sf_dir, "all-sleeves", make)


def sleeve_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_sleeves(spark, sf_dir).select("date", "asset", F.col("factor").alias("sleeve"), (F.round("score", 5) + F.lit(0.0)).alias("score"))


def _weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sleeves' scores, and (factor, date, weight, stress): weights after stress."""
    sleeves = all_sleeves(spark, sf_dir)
    wide = sleeves.groupBy("date", "asset").pivot("factor", list(SLEEVES)).agg(F.first("score"))
    many = run_sql(spark, sf_dir, text(lambda _: ctes(Dialect("spark"), *base(Dialect("spark"))) + "SELECT * FROM many", "spark"))
    w = learned_weights(spark, wide, _targets(spark, sf_dir), many, [("all", s, 21, proven) for s, (_, _, proven) in SLEEVES.items()], {"all": list(SLEEVES)}, 0.94, 0.35, 0.10)
    stress = run_sql(spark, sf_dir, text(lambda _: ctes(Dialect("spark"), RETS, MARKET, *drawdown_ctes("m", "mkt", "mdd")) + f"SELECT date, greatest(0.0, least(1.0, dd / (0.10 + {EPS}))) AS stress FROM mdd", "spark"))
    mult = f"SELECT * FROM (VALUES {values([(s, m, 0.10 * proven) for s, (_, m, proven) in SLEEVES.items()])}) AS t(factor, m, floor)"
    parts = (
        ("mult", mult), ("x", "SELECT w.factor, w.date, t.stress, greatest(mu.floor, w.weight * greatest(0.0, 1 + mu.m * t.stress)) AS x FROM @w w JOIN @stress t ON t.date = w.date JOIN mult mu ON mu.factor = w.factor"),
    )
    return sleeves, strategy_queries._sql(spark, parts, f"SELECT factor, date, stress, x / (sum(x) OVER (PARTITION BY date) + {EPS}) AS weight FROM x", w=w, stress=stress)


def sleeve_weights_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _weighted(spark, sf_dir)[1]
    return got.select(F.col("factor").alias("sleeve"), "date", (F.round("weight", 5) + F.lit(0.0)).alias("weight"), (F.round("stress", 6) + F.lit(0.0)).alias("stress"))


def ensemble_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ensemble's score of every asset and date, lowered where its history is short."""
    sleeves, weights = _weighted(spark, sf_dir)
    score = strategy_queries._sql(spark, [composed("e", "@sleeves", "(SELECT 'all' AS grp, factor, date, weight FROM @weights)", "grp")], "SELECT date, asset, score FROM e_c", sleeves=sleeves, weights=weights)
    cold = run_sql(spark, sf_dir, text(lambda d: _cold(d, given=True), "spark"), wide=scores(spark, sf_dir, tuple(REGISTRY)))
    return score.join(cold, ["date", "asset"]).select("date", "asset", (F.round(F.col("score") * F.col("score_mult"), 5) + F.lit(0.0)).alias("score"))


def _cold(d, given: bool = False) -> str:
    """(date, asset, age, coverage, range_vol, score_mult, cap_mult) of every asset and date: new assets count little and keep small.

    ``given``: all factors are there as the relation ``wide``.
    """
    c = COLD
    known = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 ELSE 0 END" for n in REGISTRY)
    over = f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {c['window'] - 1} PRECEDING AND CURRENT ROW)"
    hl, co = f"ln(greatest({EPS}, h / (l + {EPS})))", f"ln(greatest({EPS}, c / (o + {EPS})))"
    more = (
        *([] if given else [("wide", staged({n: zs(f.make()) for n, f in REGISTRY.items()}, "panel", d.name))]),
        ("cv", f"SELECT date, asset, ({known}) / {float(len(REGISTRY))!r} AS coverage FROM wide"),
        ("gk", f"SELECT date, asset, count(c) {P} AS age, CASE WHEN h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL AND o IS NOT NULL THEN greatest({EPS}, 0.5 * pow({hl}, 2) - (2 * ln(2.0) - 1) * pow({co}, 2)) END AS v FROM panel"),
        ("rv", f"SELECT date, asset, age, CASE WHEN count(v) {over} >= {c['least']} THEN sqrt(avg(v) {over} * 252.0) END AS range_vol FROM gk"),
        ("md", f"SELECT date, {d.pctl('range_vol', 0.5)} AS middle FROM rv GROUP BY date"),
        ("rc", f"SELECT r.*, CASE WHEN m.middle > 0 AND r.range_vol > 0 THEN greatest({c['floor']}, least(1.0, m.middle / r.range_vol)) ELSE {c['floor']} END AS risk FROM rv r JOIN md m ON m.date = r.date"),
    )
    return ctes(d, *more) + f"""SELECT r.date, r.asset, r.age, cv.coverage, r.range_vol,
 CASE WHEN r.age >= {c['days']} AND cv.coverage >= {c['coverage']} THEN sqrt(least(1.0, r.age / {float(c['full'])!r}) * cv.coverage) ELSE 0.0 END AS score_mult,
 CASE WHEN r.age < {c['days']} THEN 0.0 WHEN r.age >= {c['full']} THEN 1.0 ELSE ({c['cap']} + {1 - c['cap']!r} * greatest(0.0, least(1.0, (r.age - {c['days']}) / {float(c['full'] - c['days'])!r}))) * r.risk END AS cap_mult FROM rc r JOIN cv ON cv.date = r.date AND cv.asset = r.asset"""


def cold_start_whole(d, given: bool = False) -> str:
    """Multipliers of scores and caps by age, part of the factors known, and early range volatility."""
    return f"SELECT date, asset, age, {rd('coverage')} AS coverage, {rd('range_vol')} AS range_vol, {rd('score_mult')} AS score_mult, {rd('cap_mult')} AS cap_mult FROM ({_cold(d, given)}) z"


def risk_budget_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of the derived book after the regime's multiplier; models over 126 dates, as the book has 357."""
    d = Dialect("spark")
    numbered = ctes(d, RETS, ("k", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM r) z")) + "SELECT r.date, r.asset, r.ret, CAST(k.pos AS INT) AS pos FROM r JOIN k ON k.date = r.date"
    returns = run_sql(spark, sf_dir, numbered)
    mult = regime_signals(spark, regime.regime_by_date(returns, window=126), returns.select("date", "asset", "ret")).select("date", "multiplier")
    sql = ctes(d, *_book(d), MARKET, *drawdown_ctes("m", "mkt", "mdd"), *budget_ctes(d, multiplier="regime")) + f"SELECT date, {rd('b1')} AS before_overlay, {rd('multiplier')} AS multiplier, {rd('budget')} AS budget, kill FROM budget"
    return run_sql(spark, sf_dir, text(lambda _: sql, "spark"), regime=mult)


def queries() -> dict:
    return {f.__name__: f for f in (sleeve_scores_all, sleeve_weights_all, ensemble_all, risk_budget_regime)} | {
        "cold_start_whole": lambda spark, sf_dir: run_sql(spark, sf_dir, text(lambda d: cold_start_whole(d, True), "spark"), wide=scores(spark, sf_dir, tuple(REGISTRY)))
    }


def oracle_sql() -> dict[str, str]:
    return {"cold_start_whole": text(cold_start_whole, "duckdb")}
