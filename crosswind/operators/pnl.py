"""Profit and loss of books by date: what a book of the day before earned, what trading cost, what idle money earned.

Books are sparse: a weight that isn't there is zero.  A date's book meets the next date by the calendar of the returns,
so that no dense frame of dates by assets is made.

Defined results: the first date earns nothing but cash, as there is no book before it, and trades nothing; a missing
return earns nothing; dates without any weight are there, with all money idle; groups are those of ``weights``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backtest(weights: DataFrame, returns: DataFrame, by: str, bps: float | Column = 3.0, cash: float = 0.04) -> DataFrame:
    """(by, date, gross_ret, tc, cash_yield, net_ret, turnover, gross_exposure) of weights (by, date, asset, weight) and returns (date, asset, ret)."""
    zero = F.lit(0.0)
    dates = returns.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a date
    held = weights.join(dates, "date").select(by, "date", "next", "asset", F.coalesce("weight", zero).alias("weight"))
    carried = held.where("next is not null").select(by, F.col("next").alias("date"), "asset", F.col("weight").alias("was"))
    earned = carried.join(returns.select("date", "asset", "ret"), ["date", "asset"], "left").groupBy(by, "date").agg(F.sum(F.coalesce(F.col("was") * F.col("ret"), zero)).alias("gross_ret"), F.sum(F.abs("was")).alias("gross_exposure"))
    both = held.select(by, "date", "asset", F.col("weight").alias("change")).unionByName(carried.select(by, "date", "asset", (-F.col("was")).alias("change")))
    traded = both.groupBy(by, "date", "asset").agg(F.sum("change").alias("change")).groupBy(by, "date").agg(F.sum(F.abs("change")).alias("turnover"))
    first = dates.agg(F.min("date").alias("first"))
    every = weights.select(by).distinct().crossJoin(dates.select("date")).crossJoin(first)  # the result's own rows
    out = every.join(earned, [by, "date"], "left").join(traded, [by, "date"], "left")
    out = out.withColumns({"gross_ret": F.coalesce("gross_ret", zero), "gross_exposure": F.coalesce("gross_exposure", zero), "turnover": F.when(F.col("date") == F.col("first"), 0.0).otherwise(F.coalesce("turnover", zero))})
    out = out.withColumns({"tc": F.col("turnover") * (bps if isinstance(bps, Column) else F.lit(bps)) / 1e4, "cash_yield": F.greatest(zero, 1 - F.col("gross_exposure")) * cash / 252})
    return out.select(by, "date", "gross_ret", "tc", "cash_yield", (F.col("gross_ret") - F.col("tc") + F.col("cash_yield")).alias("net_ret"), "turnover", "gross_exposure")


#: Dates a year, and the least of them that a summary needs.
YEAR, LEAST_DAYS, TINY = 252.0, 20, 1e-12


def _annual(x: Column, n: Column) -> Column:
    """The compounded return a year; a total loss or worse is a loss of all."""
    growth = F.when(F.min(1 + x) <= 0, 0.0).otherwise(F.exp(F.sum(F.when(1 + x > 0, F.log(1 + x)))))
    return F.when(growth > 0, F.pow(growth, YEAR / n) - 1).otherwise(-1.0)


def performance(pnl: DataFrame, by: str) -> DataFrame:
    """One row for each ``by`` of rows (by, date, net, bench): what was earned, at what risk, and how it went with the benchmark.

    Rows without a return are left out; with fewer than ``LEAST_DAYS`` there is only ``error``.  Measures beside the benchmark are of the dates that
    have both, and null with fewer.
    """
    known = pnl.where("net is not null").select(by, "date", F.col("net").cast("double").alias("net"), F.col("bench").cast("double").alias("bench"))
    path = Window.partitionBy(by).orderBy("date")
    nav = known.withColumn("log", F.sum(F.log1p("net")).over(path))
    nav = nav.withColumn("dd", F.exp(F.col("log") - F.max("log").over(path)) - 1)
    x, n = F.col("net"), F.count("net").cast("double")
    deviation, low = F.stddev_samp("net"), F.stddev_samp(F.when(x < 0, x))
    root = YEAR**0.5
    skew = F.skewness("net") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("net") + 6)
    q = lambda p: F.percentile("net", p)
    own = {
        "days": F.count("net"), "ann_return": _annual(x, n), "ann_vol": deviation * root, "sharpe": F.avg(x) / (deviation + TINY) * root, "sortino": F.avg(x) / (low + TINY) * root, "max_dd": F.min("dd"),
        "calmar": _annual(x, n) / (F.abs(F.min("dd")) + TINY), "win_rate": F.avg((x > 0).cast("double")), "worst_day": F.min(x), "best_day": F.max(x), "skew": skew, "kurtosis": kurt, "tail_ratio": F.abs(q(0.95)) / (F.abs(q(0.05)) + TINY),
    }
    both = F.col("bench").isNotNull()
    p, m = F.when(both, x), F.when(both, F.col("bench"))
    pairs, active = F.count(m).cast("double"), p - m
    beta = F.covar_samp(p, m) / (F.var_samp(m) + TINY)
    up, down = (F.avg(F.when(side, p)) / (F.avg(F.when(side, m)) + F.lit(sign * TINY)) for side, sign in ((m > 0, 1), (m < 0, -1)))
    beside = {
        "active_return": _annual(active, pairs), "active_vol": F.stddev_samp(active) * root, "info_ratio": F.avg(active) / (F.stddev_samp(active) + TINY) * root, "bench_return": _annual(m, pairs), "beta": beta,
        "alpha": (F.avg(p) - beta * F.avg(m)) * YEAR, "correlation": F.corr(p, m), "up_capture": up, "down_capture": down, "capture_spread": up - down,
    }
    enough, enough_both = n >= LEAST_DAYS, (n >= LEAST_DAYS) & (pairs >= LEAST_DAYS)
    return nav.groupBy(by).agg(
        F.when(~enough, "insufficient history").alias("error"), *[(c if k == "days" else F.when(enough, c)).alias(k) for k, c in own.items()], *[F.when(enough_both, c).alias(k) for k, c in beside.items()]
    )
