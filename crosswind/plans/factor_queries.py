"""One query per factor over the nation-by-week panel, and all of them in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from crosswind.functions.expr import rounded, staged
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.sources.panels import given, run_sql
from crosswind.sources.shared import keyed, signature


def factor_sql(names: list[str], dialect: str) -> str:
    """date, asset and for each factor its score; for a single one also its cross-sectional z."""
    if len(names) == 1:
        x = REGISTRY[names[0]].make()
        outputs = {"score": rounded(x), "z": rounded(zs(x))}
    else:
        outputs = {n: rounded(REGISTRY[n].make()) for n in names}
    return staged(outputs, "panel", dialect, given=given(dialect))


def compute(spark: SparkSession, panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Scores of the factors as columns, for a dense panel (date, asset, o, h, l, c, v)."""
    sql = staged({n: REGISTRY[n].make() for n in names or REGISTRY}, "{panel}", "spark")
    return spark.sql(sql, panel=panel)


#: Factors of one statement; the driver's memory and time for a statement of all of them grow faster than their number.
BATCH = 15


def scores(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """(date, asset, factors): z scores, computed once for each set of factors, their definitions and the tables' files."""
    tables = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")]
    sql = [staged({n: zs(REGISTRY[n].make()) for n in names[i : i + BATCH]}, "panel", "spark", given=given("spark")) for i in range(0, len(names), BATCH)]

    def make() -> DataFrame:
        parts = [keyed(spark, lambda q=q: run_sql(spark, sf_dir, q), f"factors-{signature(spark, tables, q)}") for q in sql]
        return reduce(lambda x, y: x.join(y, ["date", "asset"]), parts).select("date", "asset", *names)

    return keyed(spark, make, f"factors-{signature(spark, tables, 'whole', *sql)}")


def queries() -> dict:
    def one(name: str):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, factor_sql([name], "spark"))

    return {f"f_{n}": one(n) for n in REGISTRY}


def oracle_sql() -> dict[str, str]:
    return {f"f_{n}": factor_sql([n], "duckdb") for n in REGISTRY}
