"""All factors against pandas: an interpreter of the expressions that shares no SQL with the engine."""

import numpy as np
import pandas as pd
import pytest

from crosswind.operators.factors import REGISTRY
from crosswind.plans.factor_queries import compute
from crosswind.sources.store import Synthetic

NAMES = sorted(REGISTRY)


class Frames:
    """Values of expressions as frames of dates by assets."""

    def __init__(self, columns):
        self.columns, self.seen = columns, {}
        self.like = next(iter(columns.values()))

    def __call__(self, x):
        if x not in self.seen:
            self.seen[x] = self.made(x)
        return self.seen[x]

    def full(self, value):
        return pd.DataFrame(value, index=self.like.index, columns=self.like.columns)

    def across(self, series):
        return self.full(np.repeat(series.to_numpy(float)[:, None], self.like.shape[1], axis=1))

    def made(self, x):
        a, k = [self(v) for v in x.args], x.kind
        return getattr(self, f"of_{k}")(a, x.extra)

    def of_col(self, a, extra):
        return self.columns[extra[0]]

    def of_lit(self, a, extra):
        return self.full(extra[0])

    def of_held(self, a, extra):
        return a[0]

    def of_op(self, a, extra):
        x, y = a
        if extra[0] in "+-*/":
            with np.errstate(all="ignore"):
                return {"+": x.add, "-": x.sub, "*": x.mul, "/": x.div}[extra[0]](y)
        hit = {">": x.gt, "<": x.lt, ">=": x.ge, "<=": x.le, "=": x.eq}[extra[0]](y).astype(float)
        return hit.where(x.notna() & y.notna())

    def of_fn(self, a, extra):
        name = extra[0]
        if name == "coalesce":
            return a[0].where(a[0].notna(), a[1])
        if name == "nullif":
            return a[0].where(a[0] != a[1])
        if name in ("greatest", "least"):  # of the known ones
            return self.full((np.fmax if name == "greatest" else np.fmin).reduce([v.to_numpy(float) for v in a]))
        with np.errstate(all="ignore"):
            return {"abs": np.abs, "sign": np.sign, "sqrt": np.sqrt, "ln": np.log, "exp": np.exp, "tanh": np.tanh, "power": np.power, "mod": np.fmod}[name](*a)

    def of_if(self, a, extra):
        return a[1].where(a[0] == 1, a[2] if len(a) > 2 else np.nan)

    def of_isnull(self, a, extra):
        return a[0].isna().astype(float)

    def of_clip(self, a, extra):
        return a[0].clip(lower=extra[0], upper=extra[1])

    def of_greatest(self, a, extra):
        known = np.logical_and.reduce([v.notna() for v in a])
        return self.full(np.maximum.reduce([v.to_numpy(float) for v in a])).where(known)

    def of_lag(self, a, extra):
        return a[0].shift(extra[0])

    def of_total(self, a, extra):
        e = a[0].expanding(min_periods=max(extra[1], 1))
        return {"avg": e.mean, "sum": e.sum, "max": e.max, "min": e.min, "stddev_samp": e.std, "count": e.count}[extra[0]]()

    def of_roll(self, a, extra):
        agg, w, mp, q = extra
        r = a[0].rolling(w, min_periods=max(mp, 2) if agg in ("stddev_samp", "var_samp") else mp)
        return r.quantile(q) if agg == "quantile" else {"avg": r.mean, "sum": r.sum, "max": r.max, "min": r.min, "stddev_samp": r.std, "var_samp": r.var, "skew": r.skew, "kurt": r.kurt, "count": r.count}[agg]()

    def of_roll2(self, a, extra):
        agg, w, mp = extra
        x, y = (v.where(a[0].notna() & a[1].notna()) for v in a)
        r = x.rolling(w, min_periods=max(mp, 2))
        return r.corr(y, pairwise=False) if agg == "corr" else r.cov(y, pairwise=False)

    def of_ema(self, a, extra):
        span, mp = extra
        return a[0].ewm(span=span, adjust=False, min_periods=mp).mean()

    def of_xs(self, a, extra):
        f = {"avg": a[0].mean, "median": a[0].median, "stddev_samp": a[0].std, "sum": a[0].sum, "max": a[0].max, "min": a[0].min, "count": a[0].count}[extra[0]]
        return self.across(f(axis=1))

    def of_rank(self, a, extra):
        return a[0].rank(axis=1, pct=True)


@pytest.fixture(scope="module")
def panel(spark):
    """A market with two crashes, a late listing and gaps."""
    bars = Synthetic(spark, assets=28, days=420, seed=11, crash=(250, 275)).bars().toPandas().sort_values(["date", "asset"]).reset_index(drop=True)
    rng = np.random.default_rng(2)
    gone = (rng.random(len(bars)) < 0.004) | ((bars.asset == "SYN003") & (bars.date < bars.date.unique()[150]))
    bars.loc[gone, ["open", "high", "low", "close", "volume"]] = np.nan
    return bars.rename(columns={"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"})


@pytest.mark.parametrize("part", range(5))
def test_factors_equal_pandas(spark, panel, part):
    names = NAMES[part::5]
    table = spark.createDataFrame(panel).replace(float("nan"), None)
    got = compute(spark, table.repartition(4, "asset").cache(), names).toPandas()
    frames = Frames({c: panel.pivot(index="date", columns="asset", values=c).astype(float) for c in "ohlcv"})
    for n in names:
        want = frames(REGISTRY[n].make())
        mine = got.pivot(index="date", columns="asset", values=n).astype(float).reindex(index=want.index, columns=want.columns)
        both = mine.notna() & want.notna()
        # a value that is 0 / 0 or not finite on one side only where a spread vanishes
        assert (mine.notna() != (want.notna() & np.isfinite(want))).to_numpy().mean() < 0.002, n
        scale = max(1e-9, float(np.nanmedian(np.abs(want.to_numpy()))))
        off = (np.abs(mine - want) > 1e-5 * scale + 1e-5 * np.abs(want)).to_numpy()[both.to_numpy()]
        assert off.mean() < 0.001, (n, off.mean())
        last = mine.iloc[-60:].to_numpy()
        last = last[np.isfinite(last)]
        assert len(last) and np.ptp(last) > 0, f"{n} has no signal"
