"""Turbulence and absorption of a cross-section of returns, by Gram matrices that slide along dates.

A window's second moments are sums over its dates.  So a task keeps the Gram matrices of one window and, from a
refit to the next, adds those of the dates that came in and subtracts those of the dates that left.  Dates are
dealt to tasks in stretches as long as a window: each row goes to two of them, however often models are refitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12
#: Fewer known assets than these give no model, nor do assets known on a smaller part of the dates.
LEAST_ASSETS, COVERAGE = 5, 0.9


class Gram:
    """Sums over dates of products of values, of values with known marks, and of known marks; a missing value is no term."""

    def __init__(self, x: np.ndarray):
        self.n, known = len(x), np.isfinite(x)
        v, m = np.where(known, x, 0.0), known.astype(float)
        self.both, self.value, self.count = v.T @ v, v.T @ m, m.T @ m

    def moved(self, other: Gram, sign: int) -> Gram:
        out = object.__new__(Gram)
        out.n = self.n + sign * other.n
        out.both, out.value, out.count = (a + sign * b for a, b in ((self.both, other.both), (self.value, other.value), (self.count, other.count)))
        return out

    def only(self, columns: np.ndarray) -> Gram:
        out, at = object.__new__(Gram), np.ix_(columns, columns)
        out.n, out.both, out.value, out.count = self.n, self.both[at], self.value[at], self.count[at]
        return out

    def covered(self) -> np.ndarray:
        """Columns that are known on enough dates."""
        return np.flatnonzero(np.diag(self.count) >= COVERAGE * self.n - 1e-9)

    def means(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.diag(self.value) / np.diag(self.count)

    def products(self) -> np.ndarray:
        """Sums of products of differences from the means, where missing values differ by nothing."""
        mean = self.means()
        mixed = self.value * mean  # of column j's mean with values of column i where j is known
        return self.both - mixed - mixed.T + self.count * np.outer(mean, mean)


def slid(x: np.ndarray, past: int, step: int) -> Iterator[tuple[int, Gram]]:
    """Anchors past, past + step, .. and the sums of the dates of the window before each."""
    held = Gram(x[:past])
    for anchor in range(past, len(x), step):
        if anchor > past:
            held = held.moved(Gram(x[anchor - step : anchor]), 1).moved(Gram(x[anchor - past - step : anchor - past]), -1)
        yield anchor, held


class Distance:
    """Squared distances from the middle of a window, in units of its shrunk covariance."""

    def __init__(self, gram: Gram, columns: np.ndarray, shrink: float):
        own = gram.only(columns)
        self.columns, self.mean = columns, own.means()
        cov = own.products() / max(1, own.n - 1)
        own_var = np.diag(cov).copy()
        cov *= 1 - shrink
        cov[np.diag_indices_from(cov)] = own_var + TINY
        self.root = np.linalg.cholesky(cov)  # raises if there is none

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows, and how many of their values are known."""
        off = x[:, self.columns] - self.mean
        known = np.isfinite(off)
        z = np.linalg.solve(self.root, np.where(known, off, 0.0).T)
        return (z * z).sum(0), known.sum(1)


def robust(gram: Gram, window: np.ndarray, shrink: float = 0.1, keep: float = 0.8) -> Distance | None:
    """The distance fitted on the nearest dates of a window: those beyond leave the sums; None where no model can be."""
    columns = gram.covered()
    if len(columns) < LEAST_ASSETS:
        return None
    try:
        every = Distance(gram, columns, shrink)
    except np.linalg.LinAlgError:
        return None
    far = np.argsort(every.of(window)[0])[max(30, int(keep * len(window))) :]
    try:
        near = gram.moved(Gram(window[far]), -1)
        return Distance(near, columns, shrink) if np.diag(near.count)[columns].all() else every
    except np.linalg.LinAlgError:
        return every


def turbulence(x: np.ndarray, past: int, step: int) -> np.ndarray:
    """For each row from ``past`` on: its distance by the last model, a value for each known asset; a model that can't be is tried for every date."""
    out = np.full(len(x) - past, np.nan)
    for anchor, gram in slid(x, past, step):
        model, end = robust(gram, x[anchor - past : anchor]), min(anchor + step, len(x))
        for t in range(anchor, end):
            if model is None and t > anchor:
                model = robust(Gram(x[t - past : t]), x[t - past : t])
            if model is not None:
                d, known = model.of(x[t:end])
                out[t - past : end - past] = np.where(known > 0, d / np.maximum(known, 1), np.nan)
                break
    return out


def absorption(x: np.ndarray, past: int, step: int, part: float = 0.2) -> np.ndarray:
    """For each row from ``past`` on: the share that the largest part of the correlations' eigenvalues has, at the last anchor."""
    out = np.full(len(x) - past, np.nan)
    for anchor, gram in slid(x, past, step):
        own = gram.only(gram.covered())
        if len(own.both) >= LEAST_ASSETS:
            products = own.products()
            spread = np.sqrt(np.maximum(np.diag(products), 0.0) / np.diag(own.count)) + TINY
            values = np.linalg.eigvalsh(products / np.outer(spread, spread))
            top = max(1, int(round(part * len(values))))
            out[anchor - past : anchor - past + step] = values[-top:].sum() / (values.sum() + TINY * (own.n - 1))
    return out


def along(returns: DataFrame, past: int, step: int, kind: str, of: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """(pos, kind) of each date from ``past`` on; ``of`` gets a stretch of dates with the window before it."""
    span = -(-past // step) * step

    def one(part: pa.Table) -> pa.Table:
        k, pos = part.column("k")[0].as_py(), part.column("pos").to_numpy()
        _, at = np.unique(part.column("asset").cast(pa.string()).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        x = np.full((min(past + span, int(pos.max()) + 1 - k * span), int(at.max()) + 1), np.nan)
        x[pos - k * span, at] = part.column("ret").to_numpy(zero_copy_only=False)
        values = of(x, past, step) if len(x) > past else np.empty(0)
        where = np.arange(len(values)) + k * span + past
        return pa.table({"pos": pa.array(where, pa.int32()), kind: pa.array(values, from_pandas=True)})

    pos = F.col("pos")
    stretches = F.sequence(F.greatest(F.lit(0), F.floor((pos - past) / span)).cast("int"), F.floor(pos / span).cast("int"))
    rows = returns.select("asset", F.col("ret").cast("double").alias("ret"), F.col("pos").cast("int").alias("pos"), F.explode(stretches).alias("k"))
    return rows.groupBy("k").applyInArrow(one, f"pos int, {kind} double")


def regime_by_date(returns: DataFrame, window: int = 504, absorbing: int = 126, step: int = 5) -> DataFrame:
    """(date, turbulence, absorption) of every date of ``returns`` (date, asset, ret, pos), pos the date's number from 0.

    Turbulence is fitted on ``window`` dates before every ``step``-th date and absorption on ``absorbing``; each date has what
    the last fit up to it says.  Both are NULL as long as the past is shorter.  An absorption without
    enough known assets is the last known one.  Dates are one row each, so carrying on runs in one task.
    """
    dates = returns.select(F.col("pos").cast("int").alias("pos"), "date").distinct()
    both = dates.join(along(returns, window, step, "turbulence", turbulence), "pos", "left").join(along(returns, absorbing, step, "absorption", absorption), "pos", "left")
    carried = F.last("absorption", ignorenulls=True).over(Window.orderBy("pos"))
    return both.select("date", "turbulence", carried.alias("absorption"))
