"""The coefficient meta-learner against pandas: states and weights of given coefficients, with gaps, late starts and groups."""

import numpy as np
import pandas as pd
import pytest

from crosswind.plans.meta_queries import learned, values
from crosswind.plans.panel_queries import Dialect
from crosswind.plans.strategy_queries import _sql

DAYS, NAMES = 260, ["a", "b", "c", "d"]
PROVEN = {"a": 1, "b": 1, "c": 0, "d": 1}


def given(seed):
    """Coefficients and numbers of assets by date, what redundancy leaves, and how many assets there are."""
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2022-01-03", periods=DAYS)
    ic = pd.DataFrame(rng.normal([0.05, 0.02, -0.03, 0.3], 0.15, (DAYS, 4)), index=dates, columns=NAMES)
    ic[rng.random(ic.shape) < 0.1] = np.nan
    ic.iloc[:120, 1] = np.nan  # starts late
    ic.iloc[100:200, 0] = np.nan  # long gone
    n = pd.DataFrame(rng.integers(5, 25, (DAYS, 4)), index=dates, columns=NAMES)
    n["c"] = np.minimum(n["c"], 9)  # seldom covered
    penalty = pd.DataFrame(rng.uniform(0.7, 1.0, (DAYS, 4)), index=dates, columns=NAMES)
    return ic, n, penalty, pd.Series(rng.integers(22, 26, DAYS), index=dates)


def brute(ic, n, penalty, many, h, lam, floor):
    """By pandas' own exponential windows and a loop over dates."""
    known, cover = ic.clip(-0.25, 0.25).shift(h + 1), (n.div(many, axis=0)).shift(h + 1)
    window = known.ewm(alpha=1 - lam, adjust=False, ignore_na=True, min_periods=21)
    mean, vol = window.mean(), window.std()
    coverage = cover.ewm(alpha=1 - lam, adjust=False, ignore_na=True, min_periods=21).mean()
    hit = (known > 0).astype(float).where(known.notna()).rolling(63, min_periods=10).mean()
    recent = mean.rolling(21, min_periods=7).mean()
    out = []
    for d in ic.index:
        m, active = mean.loc[d], mean.loc[d].notna() & (coverage.loc[d] >= 0.5)
        ir = (m / vol.loc[d].clip(lower=0.02)).clip(0, 3)
        rank = (recent.loc[d] - recent.loc[d].min()) / (recent.loc[d].max() - recent.loc[d].min() + 1e-12)
        w = m.clip(lower=0) * (0.25 + 0.75 * ir / (1 + ir)) * (0.5 + 0.5 * ((hit.loc[d] - 0.4) / 0.2).clip(0, 1)) * np.sqrt(coverage.loc[d].clip(0, 1)) * penalty.loc[d] * (1 + 0.1 * rank.fillna(0.5))
        w = w.where(active, 0.0)
        if w.sum() > 0:
            w = (w / w.sum()).fillna(1 / max(1, active.sum()))  # no hit rate yet
        else:
            w = active / active.sum() if active.any() else pd.Series(0.25, index=NAMES)
        w = np.maximum(w, [floor if active[k] and PROVEN[k] else 0.0 for k in NAMES])
        out.append(w / w.sum() if w.sum() > 0 else pd.Series(0.25, index=NAMES))
    return pd.DataFrame(out, index=ic.index), mean, vol


@pytest.mark.parametrize("h", [5, 21])
def test_states_and_weights(spark, h):
    data = {g: given(k) for k, g in enumerate(("one", "two"), 3)}
    many = data["one"][3]
    plain = lambda v: None if np.isnan(v) else float(v)
    raw = [(g, h, f, d.date(), plain(ic.loc[d, f]), int(n.loc[d, f])) for g, (ic, n, _, _) in data.items() for d in ic.index for f in NAMES]
    pen = [(g, h, f, d.date(), float(p.loc[d, f])) for g, (_, _, p, _) in data.items() for d in p.index for f in NAMES if not (f == "a" and d == p.index[5])]
    frames = {
        "raw": spark.createDataFrame(raw, "grp string, h int, factor string, date date, ic double, n long"), "pen": spark.createDataFrame(pen, "grp string, h int, factor string, date date, penalty double"),
        "many": spark.createDataFrame([(d.date(), int(v)) for d, v in many.items()], "date date, n long"),
    }
    spec = values([(g, f, h, PROVEN[f]) for g in data for f in NAMES])
    parts = [
        ("spec", f"SELECT * FROM (VALUES {spec}) AS t(grp, factor, h, proven)"), ("many", "SELECT * FROM @many"), ("f_raw", "SELECT * FROM @raw"), ("f_pe", "SELECT * FROM @pen"),
        *[(n, q) for n, q in learned(Dialect("spark"), "f", "none", "spec", 0.95, 0.30, 0.012, 0.25) if n not in ("f_met", "f_rk", "f_raw", "f_pr", "f_pe")],
    ]
    got = _sql(spark, parts, "SELECT grp, factor, date, weight, mean, vol, ir FROM f_w", **frames).toPandas()
    for g, (ic, n, penalty, _) in data.items():
        penalty = penalty.copy()
        penalty.loc[penalty.index[5], "a"] = 1.0
        want, mean, vol = brute(ic, n, penalty, many, h, 0.95, 0.012)
        own = got[got.grp == g]
        wide = lambda c: own.pivot(index="date", columns="factor", values=c).astype(float)[NAMES].to_numpy()  # noqa: B023, E731
        assert np.allclose(wide("mean"), mean.to_numpy(), atol=1e-7, equal_nan=True) and np.allclose(wide("vol"), vol.to_numpy(), atol=1e-6, equal_nan=True)
        assert (np.isnan(wide("ir")) == mean.isna().to_numpy()).all()
        assert np.abs(wide("weight") - want.to_numpy()).max() < 1e-6, (g, np.abs(wide("weight") - want.to_numpy()).max(axis=1).argmax())
    assert got.weight.nunique() > 100
