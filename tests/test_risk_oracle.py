"""Risk and regime queries against pandas on the same panel."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosswind.plans import panel_queries, risk_queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def returns(spark):
    bars = panel_queries.queries()["bars_densify"](spark, DATA).toPandas()
    close = bars.pivot(index="date", columns="asset", values="c").astype(float).sort_index()
    return close.pct_change(fill_method=None)


def got(spark, name):
    return risk_queries.queries()[name](spark, DATA).toPandas().set_index("date").sort_index().astype(float)


def test_market_and_volatility(spark, returns):
    market = returns.mean(axis=1).fillna(0.0)
    nav = (1 + market).cumprod()
    peak = nav.rolling(126, min_periods=1).max()
    mine = got(spark, "market_growth")
    assert np.allclose(mine.nav, nav, rtol=1e-4, atol=1e-5) and np.allclose(mine.drawdown, ((peak - nav) / (peak + 1e-12)).clip(0, 1), atol=1e-5)
    vol = np.sqrt((market**2).ewm(alpha=0.05, adjust=False).mean() * 252)
    assert np.allclose(got(spark, "ewma_vol").vol, vol, atol=1e-5)


def test_panic_and_breadth(spark, returns):
    market = returns.mean(axis=1).fillna(0.0)
    nav = (1 + market).cumprod()
    down = (1 - nav / (nav.rolling(126, min_periods=1).max() + 1e-12)).clip(0, 1)
    vol = market.rolling(21, min_periods=10).std() * np.sqrt(252)
    base = vol.rolling(252, min_periods=126)
    mad = base.apply(lambda v: np.nanmedian(np.abs(v - np.nanmedian(v))), raw=True)
    z = (vol - base.median()) / (1.4826 * mad + 1e-12)
    panic = np.sqrt(((down - 0.08) / 0.12).clip(0, 1) * ((z - 1) / 2).clip(0, 1)).fillna(0.0)
    mine = got(spark, "panic_state")
    assert np.allclose(mine.market_vol_z, z, rtol=1e-3, atol=1e-3, equal_nan=True) and np.allclose(mine.panic_signal, panic, atol=1e-4)
    trail = np.log1p(returns.clip(lower=-0.999)).rolling(126, min_periods=63).sum()
    up = (trail.round(9) > 0).astype(float).where(trail.notna()).mean(axis=1)
    assert np.allclose(got(spark, "breadth_smoothed").breadth, up.rolling(10, min_periods=5).mean(), atol=1e-5, equal_nan=True)


def test_rolling_ranks(spark, returns):
    mine = risk_queries.queries()["rolling_ranks"](spark, DATA).toPandas()
    x = returns.round(9)
    rank, mad = x.rolling(63, min_periods=21).rank(pct=True), x.rolling(63, min_periods=21).apply(lambda v: np.nanmedian(np.abs(v - np.nanmedian(v))), raw=True)
    for name, want in (("pct", rank), ("mad", mad)):
        have = mine.pivot(index="date", columns="asset", values=name).astype(float)
        same = np.isclose(have, want, atol=1e-6, equal_nan=True)
        assert same.mean() > 0.999, name


def test_signals_of_a_crash(spark):
    """Calm, crash, recovery: the throttle falls with the crash only, and the multiplier stays in its bounds."""
    rng = np.random.default_rng(9)
    days, assets = 420, 12
    x = rng.normal(0.0006, 0.008, (days, assets)) + rng.normal(0, 0.004, (days, 1))
    x[330:350] += rng.normal(-0.025, 0.03, (20, 1))
    dates = pd.bdate_range("2022-01-03", periods=days).date
    rows = spark.createDataFrame([(dates[t], a, float(x[t, a])) for t in range(days) for a in range(assets)], "date date, asset int, ret double")
    turb = np.where(np.arange(days) < 120, np.nan, 1.0 + 0.1 * rng.random(days))
    turb[330:352] = 6 + rng.random(22)
    fitted = spark.createDataFrame([(dates[t], None if np.isnan(turb[t]) else float(turb[t]), 0.4) for t in range(days)], "date date, turbulence double, absorption double")
    f = risk_queries.regime_signals(spark, fitted, rows).withColumn("date", F.col("date").cast("string")).toPandas().sort_values("date").reset_index(drop=True)
    assert len(f) == days and f.multiplier.between(0.6, 1.05).all() and f.throttle.between(0.6, 1.0).all()
    assert f.throttle[340:350].min() < 0.85 < f.throttle[200:330].min() and (f.regime_ready == (f.turbulence.notna())).all()
    assert f.panic_signal[335:352].max() > 0.3 and f.panic_signal[200:330].max() < 0.05
    raw = 0.3 * f.turb_signal.fillna(0) + 0.3 * f.absorption_signal + 0.2 * f.breadth_signal + 0.2 * f.panic_signal
    assert np.allclose(f.regime_risk, raw.ewm(span=5, adjust=False).mean(), atol=1e-9)


@pytest.mark.parametrize("regime", [False, True])
def test_budget_of_a_book(spark, regime):
    """Volatility target, throttle, overlay, the regime's multiplier and the latch, by pandas; through a crash that stops the book."""
    from crosswind.plans.panel_queries import MARKET, Dialect

    rng = np.random.default_rng(12)
    days, assets = 300, 6
    ret = rng.normal(0.0005, 0.01, (days, assets)) + rng.normal(0, 0.005, (days, 1))
    ret[180:200] -= 0.02
    dates = pd.bdate_range("2022-01-03", periods=days)
    w = rng.dirichlet(np.ones(assets), days)
    frame = lambda x: pd.DataFrame(x, index=dates)
    r, unit = frame(ret), frame(w)
    mult = pd.Series(rng.uniform(0.6, 1.05, days), index=dates)
    table = spark.createDataFrame([(d.date(), a, float(r.loc[d, a]), float(unit.loc[d, a])) for d in dates for a in range(assets)], "date date, asset int, ret double, w double")
    extra = spark.createDataFrame([(d.date(), float(mult[d])) for d in dates if d != dates[50]], "date date, multiplier double")
    d = Dialect("spark")
    parts = (("w", "SELECT * FROM {t}"), ("r", "SELECT date, asset, ret FROM {t}"), ("x", "SELECT * FROM {x}"), MARKET, *risk_queries.drawdown_ctes("m", "mkt", "mdd"), *risk_queries.budget_ctes(d, multiplier="x" if regime else ""))
    mine = spark.sql("WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\nSELECT date, budget, kill FROM budget", t=table, x=extra).toPandas().sort_values("date")
    port = (unit.shift(1) * r).sum(axis=1)
    down = lambda x: (1 - (1 + x).cumprod() / (1 + x).cumprod().rolling(126, min_periods=1).max()).clip(0, 1)
    dd = down(r.mean(axis=1))
    target = 0.18 + (0.12 - 0.18) * (dd / 0.10).clip(0, 1)
    lever = (target / np.sqrt((port**2).ewm(alpha=0.05, adjust=False).mean() * 252)).clip(0.4, 1.5)
    throttle = (1 - 0.7 * dd).clip(0.45, 1.0)
    over = ((0.18 / (port.rolling(63, min_periods=10).std() * 252**0.5).clip(upper=0.22)).clip(0.5, 1.25) * throttle).clip(0.5, 1.25).fillna(1.0)
    budget = ((lever * throttle).clip(0.4, 1.5) * over).clip(0.4, 1.5)
    if regime:
        mult[dates[50]] = 1.0
        budget = (budget * mult).clip(0.4, 1.5)
    own, on, kill = down(port * budget.shift(1).fillna(0.4)), False, []
    for v in own:
        on = v > 0.15 or on and not v < 0.10
        kill.append(on)
    want = budget.where(~np.array(kill), 0.0)
    assert mine.kill.tolist() == [int(k) for k in kill] and any(kill) and np.abs(mine.budget.to_numpy() - want.to_numpy()).max() < 1e-9
