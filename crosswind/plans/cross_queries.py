"""Queries over whole cross-sections: coefficients and redundancy of many factors in one pass, and the boosted learned score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.functions.expr import staged
from crosswind.operators import boosting, cross
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.plans.factor_queries import scores
from crosswind.plans.meta_queries import base
from crosswind.plans.panel_queries import IC_NAMES, P, Dialect, ctes, factor_cte, rd, text
from crosswind.sources.panels import run_sql

#: All factors by sleeve.
SLEEVES: dict[str, list[str]] = {}
for _name, _factor in REGISTRY.items():
    SLEEVES.setdefault(_factor.sleeve, []).append(_name)
#: How far redundancy lowers a weight, and the least part that stays.
STRENGTH, FLOOR, LEAST = 0.30, 0.25, 15
#: The learned score's trees are fewer than by default, as each level of a tree is a pass; its window suits the derived panel of 357 dates.
LEARNED = boosting.Boost(window=126, every=63, trees=6, depth=3, rate=0.3, least=200)


def _four(spark: SparkSession, sf_dir: str, horizon: int = 5) -> DataFrame:
    d = Dialect("spark")
    fwd = f"SELECT date, asset, {rd(f'lead(c, {horizon}) {P} / c - 1', 9)} AS fwd FROM panel"
    scores = ", ".join(f"{rd('s.' + n, 9)} AS {n}" for n in IC_NAMES)
    return run_sql(spark, sf_dir, text(lambda _: ctes(d, ("wide", factor_cte(d, *IC_NAMES)), ("fw", fwd)) + f"SELECT s.date, {scores}, f.fwd FROM wide s JOIN fw f ON f.date = s.date AND f.asset = s.asset", "spark"))


def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of four factors with returns of five dates."""
    ic = cross.rank_coefficients(_four(spark, sf_dir), list(IC_NAMES), ["fwd"], LEAST)
    return ic.select("date", "factor", (F.round("ic", 6) + F.lit(0.0)).alias("ic"), "n")


def factor_corr_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundancy of four factors by date."""
    size = cross.redundancy(_four(spark, sf_dir).drop("fwd"), {"all": list(IC_NAMES)}, LEAST).where("met > 0")
    mean = F.coalesce("mean_corr", F.lit(0.0))
    lowered = 1 - 0.5 * (1 - F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1 - mean)))
    return size.select("date", "factor", (F.round(mean, 6) + F.lit(0.0)).alias("mean_corr"), (F.round(lowered, 6) + F.lit(0.0)).alias("penalty"))


def factor_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date, sleeve and factor: mean absolute correlation with the sleeve's other factors, and what weight that leaves."""
    size = cross.redundancy(scores(spark, sf_dir, tuple(REGISTRY)), SLEEVES, LEAST).where("met > 0")
    mean = F.coalesce("mean_corr", F.lit(0.0))
    lowered = 1 - STRENGTH * (1 - F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), 1 - mean)))
    return size.select("date", F.col("grp").alias("sleeve"), "factor", "pairs", (F.round(mean, 5) + F.lit(0.0)).alias("mean_corr"), (F.round(lowered, 5) + F.lit(0.0)).alias("penalty"))


def redundancy_sql() -> str:
    """All pairs of each sleeve's factors joined by date and asset."""
    wide = staged({n: zs(f.make()) for n, f in REGISTRY.items()}, "panel", "duckdb")
    long = "SELECT date, asset, factor, score FROM (UNPIVOT wide ON * EXCLUDE (date, asset) INTO NAME factor VALUE score) u WHERE isfinite(score)"
    sleeves = ", ".join(f"('{s}', '{n}')" for s, own in SLEEVES.items() for n in own)
    more = (
        ("wide", wide), ("lo", long), ("sl", f"SELECT * FROM (VALUES {sleeves}) t(sleeve, factor)"), ("x", "SELECT l.*, s.sleeve FROM lo l JOIN sl s ON s.factor = l.factor"),
        ("p", f"SELECT a.date, a.sleeve, a.factor, CASE WHEN count(*) >= {LEAST} AND stddev_pop(a.score) * stddev_pop(b.score) * count(*) > 1e-12 THEN abs(covar_pop(a.score, b.score) / (stddev_pop(a.score) * stddev_pop(b.score))) END AS k FROM x a JOIN x b ON b.date = a.date AND b.asset = a.asset AND b.sleeve = a.sleeve AND b.factor <> a.factor GROUP BY a.date, a.sleeve, a.factor, b.factor"),
    )
    return ctes(Dialect("duckdb"), *more) + f"SELECT date, sleeve, factor, count(k) AS pairs, {rd('coalesce(avg(k), 0)', 5)} AS mean_corr, {rd(f'1 - {STRENGTH} * (1 - greatest({FLOOR}, least(1.0, 1 - coalesce(avg(k), 0))))', 5)} AS penalty FROM p GROUP BY date, sleeve, factor"


def learning_rows(spark: SparkSession, sf_dir: str, horizon: int) -> DataFrame:
    """(pos, asset, target, factors): z scores of all factors, and ranks of forward returns of liquid assets less a half."""
    d = Dialect("spark")
    more = (
        ("no", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel) z"), ("fh", f"SELECT date, asset, fwd FROM fwd WHERE h = {horizon} AND fwd IS NOT NULL"),
        ("tg", "SELECT date, asset, (rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5 AS target FROM fh"),
    )
    targets = run_sql(spark, sf_dir, text(lambda _: ctes(d, *base(d), *more) + "SELECT p.date, p.asset, CAST(no.pos AS BIGINT) AS pos, t.target FROM panel p JOIN no ON no.date = p.date LEFT JOIN tg t ON t.date = p.date AND t.asset = p.asset", "spark"))
    return targets.join(scores(spark, sf_dir, tuple(REGISTRY)), ["date", "asset"])


def ml_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward scores by boosted trees on all factors."""
    rows = learning_rows(spark, sf_dir, LEARNED.horizon)
    got = boosting.boosted_path(spark, rows.select("pos", "asset", "target", *REGISTRY), list(REGISTRY), LEARNED)
    return got.select("pos", F.col("asset").cast("long").alias("asset"), F.round("score", 6).alias("score"))


def queries() -> dict:
    return {f.__name__: f for f in (rank_ic, factor_corr_penalty, factor_redundancy, ml_score)}


def oracle_sql() -> dict[str, str]:
    from crosswind.plans import panel_queries

    plain = {n: text(f, "duckdb") for n, f in (("rank_ic", panel_queries.rank_ic), ("factor_corr_penalty", panel_queries.factor_corr_penalty))}
    return plain | {"factor_redundancy": redundancy_sql()}
