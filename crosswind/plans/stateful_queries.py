"""Registered queries of the path-dependent and matrix operators; SQL can't express these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswind.functions.expr import rounded, staged
from crosswind.operators import book
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import ret, zs
from crosswind.plans.panel_queries import Dialect, RETS, ctes
from crosswind.sources.panels import given, run_sql
from crosswind.streaming import quotes


def ewm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means of the assets' returns, with decay over gaps."""
    panel = run_sql(spark, sf_dir, staged({"ret": ret}, "panel", "spark", given=given("spark")))
    return book.ewm_by_asset(panel, "ret", 0.06, "mean", least=21).withColumn("mean", F.when(~F.isnan("mean"), F.round("mean", 6) + 0.0))


def sequential_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of two books over time, by short-term reversal and by inverse volatility."""
    scores = [
        run_sql(spark, sf_dir, staged({"score": rounded(zs(REGISTRY[n].make()))}, "panel", "spark", given=given("spark"))).select(F.lit(n).alias("strategy_id"), "date", "asset", "score") for n in ("srev", "inv_vol")
    ]
    return book.sequential_book(scores[0].unionByName(scores[1])).withColumn("weight", F.round("weight", 8))


def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming quote state over the whole event table at once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    ticks = e.select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id", F.col("value").alias("bid"), (F.col("value") * 1.001).alias("ask"), F.col("value").alias("last"))
    return quotes.latest(ticks.withColumn("ts", F.struct("ts", "event_id"))).select("symbol", F.round("mark", 6).alias("mark"))


def candles_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming candles over the whole event table at once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    trades = e.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.struct("ts", "event_id").alias("at"))
    return quotes.candles(trades, order="at").select("symbol", F.to_date("start").alias("day"), "o", "h", "l", "c", "v")


def queries() -> dict:
    return {f.__name__: f for f in (ewm_mean, sequential_book, latest_quotes, candles_by_day)}


def _ewm_sql(alpha: float = 0.06, least: int = 21) -> str:
    """The recurrence over each asset's rows: old weight shrinks a row at a time and is 1 again after a value."""
    keep = f"(p.w * {1 - alpha!r}e0)"
    mean = f"CASE WHEN p.a IS NULL THEN s.a WHEN s.a IS NULL THEN p.a ELSE ({keep} * p.a + {alpha!r}e0 * s.a) / ({keep} + {alpha!r}e0) END"
    step = f"struct_pack(a := {mean}, w := CASE WHEN p.a IS NULL OR s.a IS NOT NULL THEN 1e0 ELSE {keep} END)"
    rows = "list(struct_pack(a := ret, w := 1e0)) OVER w"
    value = f"struct_extract(list_reduce(list_prepend(struct_pack(a := CAST(NULL AS DOUBLE), w := 1e0), {rows}), lambda p, s: {step}), 'a')"
    return ctes(Dialect("duckdb"), RETS) + f"SELECT asset, date, CASE WHEN count(ret) OVER w >= {least} THEN round({value}, 6) + 0e0 END AS mean FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def oracle_sql() -> dict[str, str]:
    return {
        "ewm_mean": _ewm_sql(),
        "candles_by_day": "SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS day, arg_min(value, row(ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, row(ts, event_id)) AS c, CAST(count(*) AS DOUBLE) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2",
        "latest_quotes": "SELECT CAST(user_id AS VARCHAR) AS symbol, round(CASE WHEN v > 0 THEN (v + v * 1.001e0) / 2 END, 6) AS mark FROM (SELECT user_id, arg_max(value, row(ts, event_id)) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id) z",
    }
