"""Diagnostics of factors: snapshots of the newest scores, redundant pairs, and the state that each factor's coefficients put it in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.functions.expr import staged
from crosswind.operators import cross
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.operators.strategies import factor_rows
from crosswind.plans.factor_queries import scores
from crosswind.plans.meta_queries import factor_level, kept_scores, unpivot, values
from crosswind.plans.panel_queries import Dialect, ctes, rd, text
from crosswind.sources.panels import run_sql

# Dates of coverage and of correlations, from where a pair is told and is severe, and what a factor needs to be judged.
RECENT, BACK, TOLD, SEVERE, HISTORY, COVERED = 63, 126, 0.85, 0.92, 21, 0.50


def factor_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each factor's coverage of recent dates, and of its newest date with scores how they spread and who leads and trails."""
    wide = scores(spark, sf_dir, tuple(REGISTRY))
    stages = spark.createDataFrame([(n, f.sleeve, "proven" if f.proven else "shadow") for n, f in REGISTRY.items()], "factor string, sleeve string, stage string")
    sql = f"""WITH lo AS (SELECT date, asset, factor, CASE WHEN NOT isnan(score) THEN score END AS score FROM ({unpivot(list(REGISTRY), '{wide}')}) y),
 k AS (SELECT date, dense_rank() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM {{wide}}) d),
 cv AS (SELECT factor, avg(CASE WHEN score IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM lo JOIN k ON k.date = lo.date WHERE k <= {RECENT} GROUP BY factor),
 la AS (SELECT factor, max(date) AS date FROM lo WHERE score IS NOT NULL GROUP BY factor),
 nw AS (SELECT lo.* FROM lo JOIN la ON la.factor = lo.factor AND la.date = lo.date WHERE score IS NOT NULL),
 ag AS (SELECT factor, count(*) AS assets, stddev_pop(score) AS dispersion, avg(abs(score)) AS size, max(score) AS top_score, min(score) AS bottom_score, max_by(asset, struct(round(score, 9), -asset)) AS top, min_by(asset, struct(round(score, 9), asset)) AS bottom FROM nw GROUP BY factor)
SELECT s.factor, s.sleeve, s.stage, {rd('coalesce(cv.coverage, 0)', 4)} AS coverage, coalesce(assets, 0) AS assets, {rd('coalesce(dispersion, 0)', 5)} AS dispersion, {rd('coalesce(size, 0)', 5)} AS size, top, {rd('coalesce(top_score, 0)', 5)} AS top_score, bottom, {rd('coalesce(bottom_score, 0)', 5)} AS bottom_score
 FROM {{stages}} s LEFT JOIN cv ON cv.factor = s.factor LEFT JOIN ag ON ag.factor = s.factor"""
    return spark.sql(sql, wide=wide, stages=stages)


def _long_sql() -> tuple[tuple[str, str], ...]:
    wide = staged({n: zs(f.make()) for n, f in REGISTRY.items()}, "panel", "duckdb")
    return (("wide", wide), ("lo", "SELECT date, asset, factor, score FROM (UNPIVOT wide ON * EXCLUDE (date, asset) INTO NAME factor VALUE score) u WHERE isfinite(score)"), ("ds", "SELECT date, row_number() OVER (ORDER BY date DESC) AS k, (SELECT count(DISTINCT asset) FROM panel) AS n FROM (SELECT DISTINCT date FROM panel) d"))


def _snapshot_sql() -> str:
    """By sorted values of each factor's newest date."""
    known = values([(n, f.sleeve, "proven" if f.proven else "shadow") for n, f in REGISTRY.items()])
    return ctes(Dialect("duckdb"), *_long_sql()) + f""", s AS (SELECT * FROM (VALUES {known}) t(factor, sleeve, stage)), cv AS (SELECT l.factor, count(*) / CAST((SELECT sum(n) FROM ds WHERE k <= {RECENT}) AS DOUBLE) AS coverage FROM lo l JOIN ds ON ds.date = l.date WHERE k <= {RECENT} GROUP BY 1),
 nw AS (SELECT * FROM lo QUALIFY date = max(date) OVER (PARTITION BY factor)), ag AS (SELECT factor, count(*) AS assets, stddev_pop(score) AS dispersion, avg(abs(score)) AS size, max(score) AS top_score, min(score) AS bottom_score, first(asset ORDER BY round(score, 9) DESC, asset) AS top, first(asset ORDER BY round(score, 9), asset) AS bottom FROM nw GROUP BY factor)
SELECT s.factor, s.sleeve, s.stage, round(coalesce(cv.coverage, 0), 4) + 0.0 AS coverage, coalesce(assets, 0) AS assets, round(coalesce(dispersion, 0), 5) + 0.0 AS dispersion, round(coalesce(size, 0), 5) + 0.0 AS size, top, round(coalesce(top_score, 0), 5) + 0.0 AS top_score, bottom, round(coalesce(bottom_score, 0), 5) + 0.0 AS bottom_score
 FROM s LEFT JOIN cv ON cv.factor = s.factor LEFT JOIN ag ON ag.factor = s.factor"""


def redundancy_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of factors whose recent scores are nearly the same, and how many strategies look at both."""
    wide = scores(spark, sf_dir, tuple(REGISTRY))
    dates = wide.select("date").distinct().orderBy(F.desc("date")).limit(BACK)  # the feature: the last dates
    pairs = cross.pooled(wide.join(dates, "date"), list(REGISTRY)).where(F.abs(F.round("corr", 9)) >= TOLD)
    uses = spark.createDataFrame(factor_rows(), "strategy string, factor string")
    both = uses.join(uses.withColumnRenamed("factor", "other"), "strategy").groupBy("factor", "other").agg(F.count(F.lit(1)).alias("strategies"))  # factors of each strategy
    severity = F.when(F.abs(F.round("corr", 9)) >= SEVERE, "high_redundancy").otherwise("watch")
    found = pairs.join(both, (F.col("factor") == F.col("a")) & (F.col("other") == F.col("b")), "left")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", (F.round("corr", 5) + F.lit(0.0)).alias("corr"), severity.alias("severity"), F.coalesce("strategies", F.lit(0)).alias("strategies"))


def _warnings_sql() -> str:
    """All pairs of factors joined row by row."""
    return ctes(Dialect("duckdb"), *_long_sql()) + f""", r AS (SELECT l.* FROM lo l JOIN ds ON ds.date = l.date WHERE k <= {BACK}), u AS (SELECT * FROM (VALUES {values(factor_rows())}) t(strategy, factor)),
 p AS (SELECT a.factor AS a, b.factor AS b, count(*) AS n, CASE WHEN stddev_pop(a.score) * stddev_pop(b.score) > 1e-10 THEN covar_pop(a.score, b.score) / (stddev_pop(a.score) * stddev_pop(b.score)) END AS corr FROM r a JOIN r b ON b.date = a.date AND b.asset = a.asset AND b.factor > a.factor GROUP BY 1, 2),
 s AS (SELECT x.factor AS a, y.factor AS b, count(*) AS strategies FROM u x JOIN u y ON y.strategy = x.strategy AND y.factor > x.factor GROUP BY 1, 2)
SELECT p.a, p.b, n, round(corr, 5) + 0.0 AS corr, CASE WHEN abs(round(corr, 9)) >= {SEVERE} THEN 'high_redundancy' ELSE 'watch' END AS severity, coalesce(strategies, 0) AS strategies FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b WHERE abs(round(corr, 9)) >= {TOLD}"""


def factor_states(d) -> str:
    """The newest row of each factor, sleeve and horizon of the meta-learner, and what it makes of the factor."""
    stage = f"SELECT * FROM (VALUES {values([(n, int(f.proven)) for n, f in REGISTRY.items()])}) AS t(name, proven)"
    more = (("sg", stage), ("nw", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, h, factor ORDER BY date DESC) AS k FROM f_w) z WHERE k = 1"))
    return ctes(d, *factor_level(d), *more) + f"""SELECT n.grp AS sleeve, n.h, n.factor, n.observations, {rd('n.cov', 4)} AS coverage, {rd('n.ir', 4)} AS ir, {rd('n.weight', 5)} AS weight,
 CASE WHEN n.observations < {HISTORY} OR coalesce(n.cov, 0) < {COVERED} THEN 'insufficient_evidence' WHEN coalesce(n.ir, 0) <= 0 AND n.weight <= 0.000001 THEN 'quarantined' WHEN s.proven = 0 AND n.ir > 0 AND n.weight > 0 THEN 'shadow_active'
 WHEN n.ir > 0 AND n.weight > 0 THEN 'active' ELSE 'monitor' END AS state FROM nw n JOIN sg s ON s.name = n.factor"""


def queries() -> dict:
    return {"factor_snapshot": factor_snapshot, "redundancy_warnings": redundancy_warnings, "factor_states": lambda spark, sf_dir: run_sql(spark, sf_dir, text(factor_states, "spark"), scores=kept_scores(spark, sf_dir))}


def oracle_sql() -> dict[str, str]:
    return {"factor_snapshot": _snapshot_sql(), "redundancy_warnings": _warnings_sql(), "factor_states": text(factor_states, "duckdb")}
