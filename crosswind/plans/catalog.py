"""The factor catalog and what is derived from it: families, floors, usage and overlap of factor sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosswind.operators.factors import REGISTRY

#: Weight that a proven factor keeps at least.
FLOOR = 0.012

#: Named sets of factors, by sleeve and stage: a strategy is a set and a configuration, never code.
SETS = {
    "all_proven": [f.name for f in REGISTRY.values() if f.proven],
    "defensive": [f.name for f in REGISTRY.values() if f.sleeve == "defensive"],
    "momentum_proven": [f.name for f in REGISTRY.values() if f.sleeve == "momentum" and f.proven],
    "momentum_all": [f.name for f in REGISTRY.values() if f.sleeve == "momentum"],
    "reversal": [f.name for f in REGISTRY.values() if f.sleeve == "meanrev"],
    "flow": [f.name for f in REGISTRY.values() if f.sleeve == "micro"],
    "resilient": [f.name for f in REGISTRY.values() if f.sleeve in ("resilience", "liquidity", "defensive")],
}


def _values(rows: list[tuple]) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


CATALOG = "SELECT * FROM (VALUES " + _values([(f.name, f.sleeve, "proven" if f.proven else "shadow") for f in REGISTRY.values()]) + ") AS t(factor, sleeve, stage)"
USAGE = "SELECT * FROM (VALUES " + _values([(s, n) for s, names in SETS.items() for n in names]) + ") AS t(strategy, factor)"

SQL = {
    "factor_catalog": f"SELECT factor, sleeve, stage, CASE WHEN stage = 'proven' THEN CAST({FLOOR} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS guaranteed_floor FROM ({CATALOG}) c",
    "family_stages": f"SELECT sleeve, count(CASE WHEN stage = 'proven' THEN 1 END) AS proven, count(CASE WHEN stage = 'shadow' THEN 1 END) AS shadow FROM ({CATALOG}) c GROUP BY sleeve",
    "factor_usage": f"SELECT c.factor, c.sleeve, count(u.strategy) AS strategies FROM ({CATALOG}) c LEFT JOIN ({USAGE}) u ON u.factor = c.factor GROUP BY c.factor, c.sleeve",
    "strategy_coverage": f"""SELECT u.strategy, count(*) AS factors, CAST(round(avg(CASE WHEN c.stage = 'shadow' THEN 1e0 ELSE 0e0 END), 6) AS DOUBLE) AS shadow_ratio,
 avg(CASE WHEN c.stage = 'shadow' THEN 1e0 ELSE 0e0 END) >= 0.4e0 AS watch FROM ({USAGE}) u JOIN ({CATALOG}) c ON c.factor = u.factor GROUP BY u.strategy""",
    "registry_overlap": f"""WITH u AS ({USAGE}), n AS (SELECT strategy, count(*) AS n FROM u GROUP BY strategy)
SELECT a.strategy AS a, b.strategy AS b, round(CAST(count(*) AS DOUBLE) / (max(x.n) + max(y.n) - count(*)), 6) AS jaccard FROM u a JOIN u b ON a.factor = b.factor AND a.strategy < b.strategy
 JOIN n x ON x.strategy = a.strategy JOIN n y ON y.strategy = b.strategy GROUP BY a.strategy, b.strategy""",
}


def queries() -> dict:
    def one(sql: str):
        return lambda spark, sf_dir: spark.sql(sql)

    return {n: one(q) for n, q in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def catalog(spark: SparkSession) -> DataFrame:
    return spark.sql(SQL["factor_catalog"])
