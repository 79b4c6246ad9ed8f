"""Cross-sections against pandas, and exponential means as scans against its recurrence."""

import numpy as np
import pandas as pd
import pytest

from crosswind.functions.expr import X, col, staged
from crosswind.operators import cross
from crosswind.plans.panel_queries import Dialect
from crosswind.plans.risk_queries import ewm_ctes


def wide(seed=1, days=6, assets=40, names=("a", "b", "c", "d", "y")):
    rng = np.random.default_rng(seed)
    rows = []
    for d in pd.date_range("2024-01-01", periods=days).date:
        x = np.round(rng.normal(size=(assets, len(names))), 1) + rng.normal(size=(assets, 1)) + 50
        x[rng.random(x.shape) < 0.2] = np.nan
        rows += [(d, i, *r) for i, r in enumerate(x)]
    out = pd.DataFrame(rows, columns=["date", "asset", *names])
    out.loc[out.date == out.date.iloc[-1], "d"] = 7.0  # without spread
    out.loc[(out.date == out.date.iloc[0]) & (out.asset > 9), "c"] = np.nan  # too few
    return out


def test_redundancy_and_coefficients(spark):
    frame = wide()
    table = spark.createDataFrame(frame).repartition(5)
    got = cross.redundancy(table, {"one": ["a", "b", "c", "d"], "two": ["a", "c"]}, 15).toPandas().set_index(["date", "grp", "factor"])
    for date, part in frame.groupby("date"):
        for grp, own in (("one", ["a", "b", "c", "d"]), ("two", ["a", "c"])):
            size = part[[n for n in own if part[n].nunique() > 1]].corr(min_periods=15).abs().reindex(index=own, columns=own)
            for n in own:
                other = size[n].drop(n).dropna()
                mine = got.loc[(date, grp, n)]
                assert mine.pairs == len(other) and (np.isnan(mine.mean_corr) if other.empty else abs(mine.mean_corr - other.mean()) < 1e-9), (date, grp, n)
    ic = cross.rank_coefficients(table, ["a", "b", "c", "d"], ["y"], 15).toPandas().set_index(["date", "factor"])
    for date, part in frame.groupby("date"):
        for n in "abcd":
            both = part[[n, "y"]].dropna()
            mine = ic.loc[(date, n)]
            assert mine.n == len(both)
            if len(both) < 15 or both[n].nunique() == 1:
                assert np.isnan(mine.ic)
            else:
                assert abs(mine.ic - both.rank().corr().iloc[0, 1]) < 1e-12


def test_pooled_pairs(spark):
    frame = wide(3, days=9)
    names = ["a", "b", "c", "d"]
    got = cross.pooled(spark.createDataFrame(frame).repartition(6), names).toPandas().set_index(["a", "b"])
    assert len(got) == 6
    for (a, b), row in got.iterrows():
        both = frame[[a, b]].dropna()
        assert row.n == len(both) and abs(row["corr"] - both.corr().iloc[0, 1]) < 1e-7
    assert cross.pooled(spark.createDataFrame(frame).where("1 = 0"), names).count() == 0


def test_ranks_share_ties():
    x = np.array([3.0, 1.0, 3.0, 2.0, 3.0])
    assert cross.ranks(x).tolist() == pd.Series(x).rank().tolist() and cross.ranks(np.empty(0)).tolist() == []


def gappy(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:7, 1], x[20 : n - 20, 2], x[:, 3] = np.nan, np.nan, np.nan  # a late start, a long gap, nothing
    return pd.DataFrame(x, index=pd.date_range("2000-01-01", periods=n).date, columns=list("pqrs"))


@pytest.mark.parametrize("span", [2, 10, 126])
def test_scan_equals_the_recurrence(spark, span):
    """Over many blocks of running sums, gaps longer than a block included."""
    x = gappy(span, 1500)
    long = x.rename_axis("date").reset_index().melt("date", var_name="asset", value_name="c")
    table = spark.createDataFrame(long).replace(float("nan"), None)
    sql = staged({"m": X("ema", (col("c"),), (span, max(1, span // 2)))}, "{panel}", "spark")
    got = spark.sql(sql, panel=table).toPandas().pivot(index="date", columns="asset", values="m").astype(float)
    want = x.ewm(span=span, adjust=False, min_periods=max(1, span // 2)).mean()
    assert (got.isna() == want.isna()).to_numpy().all() and np.nanmax(np.abs(got - want).to_numpy()) < 1e-12


@pytest.mark.parametrize("alpha", [0.02, 1 / 3, 0.9])
def test_sums_equal_the_recurrence_without_gaps(spark, alpha):
    x = gappy(4, 1500)
    long = x.rename_axis("date").reset_index().melt("date", var_name="k", value_name="x")
    table = spark.createDataFrame(long).replace(float("nan"), None)
    parts = ewm_ctes(Dialect("spark"), "src", "e", alpha, {"m": "x", "q": "x * x"}, "k")
    sql = "WITH src AS (SELECT * FROM {t}),\n" + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\nSELECT * FROM e"
    got = spark.sql(sql, t=table).toPandas()
    assert sorted(got.columns) == ["date", "k", "m", "q", "x"]
    for c, f in (("m", x), ("q", x * x)):
        want = f.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        mine = got.pivot(index="date", columns="k", values=c).astype(float)
        assert (mine.isna() == want.isna()).to_numpy().all() and np.nanmax(np.abs(mine - want).to_numpy()) < 1e-12
