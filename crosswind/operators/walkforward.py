"""Walk-forward report: what each strategy did in each year, what it had shown before, and which one that would have picked.

Fold, knob and strategy are keys of one plan.  A fold's training is all dates before it, less the horizon that its
last targets reach over; as it is a beginning of the history, it is a running sum looked up at one date, and no row is copied to folds.

Defined results: years with fewer than ``least_days`` dates are no folds; a fold with less training has a null Sharpe ratio and picks nothing; of equal
ones the first by name is picked; null returns and turnovers count as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

YEAR, TINY = 252.0, 1e-12


def sharpe(mean, spread):
    return mean / (spread + TINY) * YEAR**0.5


def folds(pnl: DataFrame, knobs: dict[str, float], horizon: int = 21, least_days: int = 40) -> DataFrame:
    """(knob, fold, strategy, train_days, train_sharpe, test_days, test_net, test_sharpe, test_max_dd, picked) of ``pnl`` (strategy, date, gross, turnover); knobs are costs in basis points."""
    dates = pnl.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    cost = F.explode(F.create_map(*[F.lit(v) for k, bps in knobs.items() for v in (k, float(bps))])).alias("knob", "bps")
    net = F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) * F.col("bps") / 1e4
    rows = pnl.join(dates, "date").select("strategy", "date", "pos", "gross", "turnover", cost).select("strategy", "knob", "date", "pos", F.year("date").alias("fold"), net.alias("net"))
    years = dates.groupBy(F.year("date").alias("fold")).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("days")).where(F.col("days") >= least_days)
    so_far = Window.partitionBy("strategy", "knob").orderBy("pos")
    known = rows.select("strategy", "knob", "pos", F.count("net").over(so_far).alias("train_days"), sharpe(F.avg("net").over(so_far), F.stddev_samp("net").over(so_far)).alias("train_sharpe"))
    trained = known.join(years.select("fold", (F.col("first") - horizon - 1).alias("pos")), "pos").where(F.col("train_days") >= least_days)
    inside = Window.partitionBy("strategy", "knob", "fold").orderBy("pos")
    value = rows.join(years.select("fold"), "fold").withColumn("nav", F.exp(F.sum(F.log1p("net")).over(inside))).withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(inside)))
    tested = value.groupBy("strategy", "knob", "fold").agg(F.count("net").alias("test_days"), (F.max_by("nav", "pos") - 1).alias("test_net"), sharpe(F.avg("net"), F.stddev_samp("net")).alias("test_sharpe"), F.max(1 - F.col("nav") / F.col("peak")).alias("test_max_dd"))
    both = tested.join(trained.select("strategy", "knob", "fold", "train_days", "train_sharpe"), ["strategy", "knob", "fold"], "left")
    best = Window.partitionBy("knob", "fold").orderBy(F.round("train_sharpe", 9).desc_nulls_last(), "strategy")
    return both.withColumn("picked", (F.row_number().over(best) == 1) & F.col("train_sharpe").isNotNull())


def verdicts(report: DataFrame, base: str) -> DataFrame:
    """(knob, folds, profitable, worst_net, least_sharpe, median_sharpe, verdict) of the strategies picked.

    FRAGILE where another knob's median is under a quarter of a positive base, or medians spread by over the base's size and one.
    """
    picked = report.where("picked").groupBy("knob").agg(
        F.count(F.lit(1)).alias("folds"), F.avg((F.col("test_net") > 0).cast("double")).alias("profitable"), F.min("test_net").alias("worst_net"), F.min("test_sharpe").alias("least_sharpe"), F.percentile("test_sharpe", 0.5).alias("median_sharpe")
    )
    every = Window.partitionBy()  # a row for each knob
    own = F.max(F.when(F.col("knob") == base, F.col("median_sharpe"))).over(every)
    worst, best = (f(F.when(F.col("knob") != base, F.col("median_sharpe"))).over(every) for f in (F.min, F.max))
    fragile = ((own > 0) & (worst < 0.25 * own)) | (best - worst > F.greatest(F.lit(1.0), F.abs(own)))
    return picked.withColumn("verdict", F.when(fragile, "FRAGILE").otherwise("ROBUST"))
