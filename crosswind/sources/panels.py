"""Bars and dense panels from order and event tables, and panels given as bars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from crosswind.sources.shared import keyed, signature

#: Ties in a bar's first and last price go by this whole key.
_KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def bars_sql(dialect: str, asset: str = "s.s_nationkey", freq: str = "week", via: str = "") -> str:
    """Bars of unit prices of line items by asset and period: date, asset, o, h, l, c, v; ``via`` joins what ``asset`` needs."""
    spark = dialect == "spark"
    key = f"struct({_KEY})" if spark else f"row({_KEY})"
    first, last = ("min_by", "max_by") if spark else ("arg_min", "arg_max")
    px = "l_extendedprice / l_quantity"
    return f"""SELECT CAST(date_trunc('{freq}', l_shipdate) AS DATE) AS date, CAST({asset} AS BIGINT) AS asset, {first}({px}, {key}) AS o, max({px}) AS h, min({px}) AS l,
 {last}({px}, {key}) AS c, sum(l_quantity) AS v FROM lineitem JOIN supplier s ON l_suppkey = s.s_suppkey {via} WHERE l_quantity > 0 GROUP BY 1, 2"""


def dense_sql(bars: str = "bars") -> str:
    """Every asset on every date; missing bars are NULL."""
    return f"SELECT d.date, a.asset, b.o, b.h, b.l, b.c, b.v FROM (SELECT DISTINCT date FROM {bars}) d CROSS JOIN (SELECT DISTINCT asset FROM {bars}) a LEFT JOIN {bars} b ON b.date = d.date AND b.asset = a.asset"


#: The derived bars by name, each with its asset, period and join: nations by week, and regions by day, few assets with a long history.
DERIVED = {"weekly_bars": ("s.s_nationkey", "week", ""), "daily_bars": ("n.n_regionkey", "day", "JOIN nation n ON n.n_nationkey = s.s_nationkey")}


def given(dialect: str, bars: str = "weekly_bars") -> tuple[tuple[str, str], ...]:
    """``bars`` and ``panel``; a statement names them often, so that Spark reads them where ``run_sql`` keeps them."""
    if dialect == "spark":
        return (("bars", f"SELECT * FROM {bars}"), ("panel", f"SELECT * FROM {bars.replace('bars', 'panel')}"))
    return (("bars", bars_sql(dialect, *DERIVED[bars])), ("panel", dense_sql()))


def given_daily(dialect: str) -> tuple[tuple[str, str], ...]:
    return given(dialect, "daily_bars")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def derived(spark: SparkSession, sf_dir: str, bars: str) -> dict[str, DataFrame]:
    """Bars and their dense panel by name: made of the line items once for the tables' files, as all that reads them reads few rows a date."""
    sql = bars_sql("spark", *DERIVED[bars])
    key = signature(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES if re.search(rf"\b{t}\b", sql)], sql)
    made = keyed(spark, lambda: run_sql(spark, sf_dir, sql), f"bars-{key}")
    return {bars: made, bars.replace("bars", "panel"): keyed(spark, lambda: run_sql(spark, sf_dir, dense_sql("made"), made=made), f"panel-{key}")}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **more: DataFrame) -> DataFrame:
    """SQL over the Parquet tables of a folder, derived bars and panels, and frames by name, without names that stay in the session."""
    for bars in DERIVED:
        found = {n: f for n, f in derived(spark, sf_dir, bars).items() if re.search(rf"\b{n}\b", sql)} if re.search(rf"\b{bars}\b", sql) else {}
        more = found | more
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {f"_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used} | {f"_{n}": f for n, f in more.items()}
    held = sql.replace("{", "{{").replace("}", "}}")
    for t in [*used, *more]:
        held = re.sub(rf"(\b(?:FROM|JOIN)\s+){t}\b", rf"\1{{_{t}}}", held, flags=re.I)
    return spark.sql(held, **frames)
