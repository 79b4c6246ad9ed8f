"""Turbulence and absorption against plain NumPy over each window's rows, without sums that slide."""

import numpy as np
import pandas as pd

from crosswind.operators import regime


def filled(x):
    """Differences from the columns' known means, 0 where missing."""
    return np.nan_to_num(x - np.nanmean(x, axis=0), nan=0.0)


def covariance(x):
    y = filled(x)
    full = np.einsum("ti,tj->ij", y, y) / (len(x) - 1)
    return 0.9 * full + 0.1 * np.diag(np.diag(full)) + 1e-12 * np.eye(full.shape[1])


def brute_turbulence(x, past, step):
    out, model = np.full(len(x), np.nan), None
    for t in range(past, len(x)):
        if (t - past) % step == 0 or model is None:
            w = x[t - past : t]
            cols = [j for j in range(x.shape[1]) if np.isfinite(w[:, j]).sum() >= 0.9 * past - 1e-9]
            model = None
            if len(cols) >= 5:
                w, inverse = w[:, cols], np.linalg.inv(covariance(w[:, cols]))
                d = np.einsum("ti,ij,tj->t", filled(w), inverse, filled(w))
                near = w[np.argsort(d)[: max(30, int(0.8 * past))]]
                model = cols, np.nanmean(near, axis=0), np.linalg.inv(covariance(near))
        if model is not None:
            cols, mean, inverse = model
            known = np.isfinite(x[t, cols])
            if known.any():
                y = np.where(known, x[t, cols] - mean, 0.0)
                out[t] = y @ inverse @ y / known.sum()
    return out


def brute_absorption(x, past, step):
    out, last = np.full(len(x), np.nan), np.nan
    for t in range(past, len(x)):
        if (t - past) % step == 0:
            w = x[t - past : t]
            cols = [j for j in range(x.shape[1]) if np.isfinite(w[:, j]).sum() >= 0.9 * past - 1e-9]
            if len(cols) >= 5:
                z = filled(w[:, cols]) / (np.nanstd(w[:, cols], axis=0) + 1e-12)
                values = np.sort(np.linalg.svd(z, compute_uv=False) ** 2 / (past - 1))[::-1]
                last = values[: max(1, round(0.2 * len(cols)))].sum() / values.sum()
        out[t] = last
    return out


def panel(days, assets, seed, gaps=0.03):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(days, assets)) * 0.01 + rng.normal(size=(days, 1)) * 0.008
    x[rng.random(x.shape) < gaps] = np.nan
    return x


def table(spark, x):
    dates = pd.date_range("2020-01-01", periods=len(x)).date
    rows = [(dates[i], f"A{j}", None if np.isnan(x[i, j]) else float(x[i, j]), i) for i in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "date date, asset string, ret double, pos int"), dates


def test_equal_to_brute_force(spark):
    x = panel(310, 9, 5)
    x[203] = x[203] * 20  # between two fits
    x[150:, 8] = np.nan  # delisted
    x[40:52, :6] = np.nan  # for a while too few are covered
    x[222] = np.nan
    rows, dates = table(spark, x)
    got = regime.regime_by_date(rows.repartition(7), window=60, absorbing=40, step=5).toPandas().sort_values("date")
    assert got.date.tolist() == list(dates)
    for kind, want in (("turbulence", brute_turbulence(x, 60, 5)), ("absorption", brute_absorption(x, 40, 5))):
        mine = got[kind].to_numpy(float)
        assert (np.isnan(mine) == np.isnan(want)).all(), (kind, np.flatnonzero(np.isnan(mine) != np.isnan(want)))
        assert np.nanmax(np.abs(mine - want) / np.maximum(1, np.abs(want))) < 1e-9
    assert int(np.nanargmax(got.turbulence)) == 203 and np.isnan(got.turbulence[:60]).all()


def test_full_windows_and_causality(spark):
    x = panel(640, 6, 8)
    x[600:] *= 6
    rows, _ = table(spark, x)
    got = regime.regime_by_date(rows).toPandas().sort_values("date").turbulence.to_numpy(float)
    want = brute_turbulence(x, 504, 5)
    assert np.isfinite(got[504:]).mean() > 0.99 and np.nanmax(np.abs(got - want) / np.maximum(1, np.abs(want))) < 1e-9
    assert np.nanmedian(got[600:604]) > 3 * np.nanmedian(got[504:600])
    cut = regime.regime_by_date(rows.where("pos < 580")).toPandas().sort_values("date").turbulence.to_numpy(float)
    assert np.allclose(cut, got[:580], equal_nan=True, rtol=1e-12)


def test_each_row_goes_to_two_stretches(spark):
    x = panel(400, 5, 1)
    seen = []

    def count(block, past, step):
        seen.append(len(block))
        return np.full(len(block) - past, float(len(block)))

    rows, _ = table(spark, x)
    got = regime.along(rows, 100, 5, "k", count).toPandas()
    assert sorted(got.pos) == list(range(100, 400)) and got.k.max() == 200  # a window and as many dates beyond it


def test_few_assets_and_short_history(spark):
    rows, _ = table(spark, panel(80, 4, 2))
    got = regime.regime_by_date(rows, window=60, absorbing=40).toPandas()
    assert len(got) == 80 and got.turbulence.isna().all() and got.absorption.isna().all()
    rows, _ = table(spark, panel(30, 8, 2))
    got = regime.regime_by_date(rows, window=60, absorbing=40).toPandas()
    assert len(got) == 30 and got.turbulence.isna().all()
