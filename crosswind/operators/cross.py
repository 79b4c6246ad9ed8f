"""Cross-sections of many factors at once: a date's assets by factors is one matrix, whatever is asked of it.

Rows are shuffled once, by date, with all factors side by side; no factor is joined with another one.  A date's
cross-section is one group, as large as the number of assets.

Defined results: a pair counts assets where both values are known, a correlation needs ``least`` of them and spread
on both sides; ties share their average rank; dates without any row are not in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def correlations(x: np.ndarray, least: int) -> np.ndarray:
    """Of columns over the rows where both are known, from products of one matrix with itself; NaN without enough rows or spread."""
    known = np.isfinite(x)
    with np.errstate(invalid="ignore"):
        middle = np.where(known, x, 0.0).sum(0) / np.maximum(known.sum(0), 1)
    v, m = np.where(known, x - middle, 0.0), known.astype(float)
    n, sums, squares = m.T @ m, v.T @ m, (v * v).T @ m  # row i: of column i where column j is known
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = squares - sums * sums / n
        spread[spread <= 1e-10 * squares] = 0.0  # what is left of equal values
        both = np.sqrt(np.maximum(spread, 0.0) * np.maximum(spread.T, 0.0))
        out = (v.T @ v - sums * sums.T / n) / both
    out[(n < least) | ~(both > TINY)] = np.nan
    return out


def ranks(x: np.ndarray) -> np.ndarray:
    """From 1, ties averaged."""
    order = np.argsort(x, kind="stable")
    new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def _columns(part: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([part.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)


def _doubles(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.select("date", *[F.col(n).cast("double").alias(n) for n in names])


def redundancy(wide: DataFrame, groups: dict[str, list[str]], least: int = 15) -> DataFrame:
    """(date, grp, factor, mean_corr, pairs, met): the mean absolute correlation of each factor with the others of its group, null without any.

    ``pairs`` counts correlations, ``met`` the other factors that are known on an asset with it.
    """
    names = sorted({n for own in groups.values() for n in own})
    place = {n: i for i, n in enumerate(names)}

    def one(part: pa.Table) -> pa.Table:
        x = _columns(part, names)
        size, known = np.abs(correlations(x, least)), np.isfinite(x).astype("i4")
        shared = known.T @ known > 0
        np.fill_diagonal(shared, False)
        rows = []
        for grp, own in groups.items():
            at = [place[n] for n in own]
            mine = size[np.ix_(at, at)]
            np.fill_diagonal(mine, np.nan)
            pairs = np.isfinite(mine).sum(1)
            mean = np.nansum(mine, 1) / np.maximum(pairs, 1)
            rows += [(grp, n, float(c) if k else None, int(k), int(j)) for n, c, k, j in zip(own, mean, pairs, shared[np.ix_(at, at)].sum(1))]
        cells = list(zip(*rows, strict=True))
        return pa.table({"date": pa.array([part.column("date")[0].as_py()] * len(rows), part.schema.field("date").type), "grp": pa.array(cells[0]), "factor": pa.array(cells[1]), "mean_corr": pa.array(cells[2], pa.float64()), "pairs": pa.array(cells[3], pa.int64()), "met": pa.array(cells[4], pa.int64())})

    kind = dict(wide.dtypes)["date"]
    return _doubles(wide, names).groupBy("date").applyInArrow(one, f"date {kind}, grp string, factor string, mean_corr double, pairs long, met long")


def rank_coefficients(wide: DataFrame, names: list[str], targets: list[str], least: int = 15) -> DataFrame:
    """(date, factor, target, ic, n): rank correlations of factors with targets over the rows that know both; none for pairs without any row."""

    def one(part: pa.Table) -> pa.Table:
        x, y = _columns(part, names), _columns(part, targets)
        rows = []
        for j, target in enumerate(targets):
            for i, name in enumerate(names):
                both = np.isfinite(x[:, i]) & np.isfinite(y[:, j])
                if both.any():
                    c = correlations(np.stack([ranks(x[both, i]), ranks(y[both, j])], 1), least)[0, 1]
                    rows.append((name, target, float(c) if np.isfinite(c) else None, int(both.sum())))
        cells = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table({"date": pa.array([part.column("date")[0].as_py()] * len(rows), part.schema.field("date").type), "factor": pa.array(cells[0], pa.string()), "target": pa.array(cells[1], pa.string()), "ic": pa.array(cells[2], pa.float64()), "n": pa.array(cells[3], pa.int64())})

    kind = dict(wide.dtypes)["date"]
    return _doubles(wide, [*names, *targets]).groupBy("date").applyInArrow(one, f"date {kind}, factor string, target string, ic double, n long")


def pooled(wide: DataFrame, names: list[str], least: int = 2) -> DataFrame:
    """(a, b, n, corr) of every pair of columns over all rows that know both, whatever their date.

    A task adds up its rows' products as it reads them; what is shuffled are sums of pairs, a set for each task.  Values are z scores or
    of that size, so that sums of squares lose nothing.
    """
    from collections.abc import Iterator

    columns = ("n", "a_sum", "b_sum", "a_square", "b_square", "product")
    upper = np.triu_indices(len(names), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], 1)
            known = np.isfinite(x)
            v, m = np.where(known, x, 0.0), known.astype(float)
            sums, squares = v.T @ m, (v * v).T @ m
            now = np.stack([m.T @ m, sums, sums.T, squares, squares.T, v.T @ v])
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *[pa.array(t[upper]) for t in total]], names=["i", "j", *columns])

    sums = wide.select(*[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in columns))
    added = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in columns])
    spread = lambda s: F.col(f"{s}_square") - F.col(f"{s}_sum") * F.col(f"{s}_sum") / F.col("n")
    own = lambda s: F.when(spread(s) > 1e-10 * F.col(f"{s}_square"), spread(s))
    corr = F.when(F.col("n") >= least, (F.col("product") - F.col("a_sum") * F.col("b_sum") / F.col("n")) / F.sqrt(own("a") * own("b")))
    said = F.array(*[F.lit(n) for n in names])
    return added.select(F.get(said, F.col("i")).alias("a"), F.get(said, F.col("j")).alias("b"), F.col("n").cast("long").alias("n"), corr.alias("corr"))
