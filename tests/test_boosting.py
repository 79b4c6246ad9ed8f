"""The boosted score against plain NumPy: splits by trying every cut on the rows themselves, no histogram."""

import numpy as np
import pytest

from crosswind.operators import boosting


def brute(pos, target, x, p):
    """z scores by row, NaN before the first refit and for rows without a feature."""
    edges, days = p.edges(), int(pos.max()) + 1
    code = np.where(np.isfinite(x), (x[:, :, None] >= edges).sum(2) + 1, 0)
    some = (code > 0).any(1)
    trained, out = None, np.full(len(x), np.nan)

    def grown(rows, residual, weight, depth):
        """A function from codes to values."""
        g, w = (weight[rows] * residual[rows]).sum(), weight[rows].sum()
        value, best = p.rate * g / (w + p.ridge), (0.0, None)
        if depth:
            for f in range(x.shape[1]):
                for cut in range(1, p.bins + 1):
                    for missing_left in (False, True):
                        left = np.where(code[rows, f] == 0, missing_left, code[rows, f] <= cut)
                        a, b = rows[left], rows[~left]
                        wa, wb = weight[a].sum(), weight[b].sum()
                        if wa >= p.leaf and wb >= p.leaf:
                            gain = round((weight[a] * residual[a]).sum() ** 2 / (wa + p.ridge) + (weight[b] * residual[b]).sum() ** 2 / (wb + p.ridge) - g * g / (w + p.ridge), 10)
                            if gain > best[0]:
                                best = (gain, (f, cut, missing_left, a, b))
        if best[1] is None:
            return lambda c: np.full(len(c), value)
        f, cut, missing_left, a, b = best[1]
        one, two = grown(a, residual, weight, depth - 1), grown(b, residual, weight, depth - 1)
        return lambda c: np.where(np.where(c[:, f] == 0, missing_left, c[:, f] <= cut), one(c), two(c))

    for t in range(p.window + p.horizon, days):
        if trained is None or t % p.every == 0:
            rows = np.flatnonzero((pos >= t - p.window - p.horizon) & (pos < t - p.horizon) & np.isfinite(target) & some)
            if len(rows) >= p.least:
                weight = 0.5 ** ((t - p.horizon - 1 - pos) / p.half_life)
                trained, told = [], np.zeros(len(x))
                for _ in range(p.trees):
                    trained.append(grown(rows, target - told, weight, p.depth))
                    told += trained[-1](code)
        if trained is not None:
            now = np.flatnonzero((pos == t) & some)
            score = sum(tree(code[now]) for tree in trained)
            out[now] = (score - score.mean()) / (score.std(ddof=1) + 1e-12) if len(now) > 1 else np.nan
    return out


def planted(days=70, assets=14, seed=3):
    rng = np.random.default_rng(seed)
    pos, asset = np.repeat(np.arange(days), assets), np.tile(np.arange(assets), days)
    x = rng.normal(size=(days * assets, 3))
    target = np.where(x[:, 0] > 0.3, 0.2, -0.1) + np.where(np.isnan(x[:, 1]), 0.1, 0.0) + 0.05 * x[:, 2] + 0.02 * rng.normal(size=len(x))
    x[rng.random(x.shape) < 0.15] = np.nan
    x[5], x[900 % len(x)] = np.nan, np.nan
    target[rng.random(len(x)) < 0.05] = np.nan
    target[(pos >= 40) & (pos < 58)] = np.nan  # a refit with too few rows
    return pos, asset, target, x


P = boosting.Boost(window=24, every=10, horizon=3, half_life=12.0, trees=3, depth=2, rate=0.5, ridge=1.0, least=120, leaf=3.0, bins=8)


def table(spark, pos, asset, target, x):
    plain = lambda v: None if np.isnan(v) else float(v)
    rows = [(int(p), str(a), plain(t), *map(plain, r)) for p, a, t, r in zip(pos, asset, target, x)]
    return spark.createDataFrame(rows, "pos long, asset string, target double, u double, v double, w double")


def test_scores_equal_brute_force(spark):
    pos, asset, target, x = planted()
    want = brute(pos, target, x, P)
    got = boosting.boosted_path(spark, table(spark, pos, asset, target, x).repartition(5), ["u", "v", "w"], P).toPandas()
    mine = dict(zip(zip(got.pos, got.asset.astype(int)), got.score))
    known = ~np.isnan(want)
    assert set(mine) == set(zip(pos[known], asset[known]))
    assert max(abs(mine[p, a] - w) for p, a, w in zip(pos[known], asset[known], want[known])) < 1e-9
    held = [r["at"] for r in boosting.refits(boosting.coded(table(spark, pos, asset, target, x), ["u", "v", "w"], P), P).orderBy("at").collect()]
    assert held == [27, 30, 40, 50]  # at 60 too few targets are known, so the model of 50 stays in force


def test_nothing_later_counts_and_scores_are_kept(spark):
    pos, asset, target, x = planted(seed=5)
    target[(pos >= 40) & (pos < 58)] = 0.1
    every = boosting.boosted_path(spark, table(spark, pos, asset, target, x), ["u", "v", "w"], P).toPandas().set_index(["pos", "asset"]).score
    early = pos < 55
    cut = boosting.boosted_path(spark, table(spark, pos[early], asset[early], target[early], x[early]), ["u", "v", "w"], P).toPandas().set_index(["pos", "asset"]).score
    assert len(cut) and (every.reindex(cut.index) - cut).abs().max() < 1e-12
    coded = boosting.coded(table(spark, pos, asset, target, x), ["u", "v", "w"], P)
    assert boosting.digest(coded, ["u", "v", "w"], P) == boosting.digest(coded.repartition(7), ["u", "v", "w"], P)
    assert boosting.digest(coded, ["u", "v", "w"], P) != boosting.digest(coded.where("pos < 60"), ["u", "v", "w"], P)


def test_signal_is_found(spark):
    pos, asset, _, x = planted(days=90, seed=9)
    target = np.where(np.nan_to_num(x[:, 0], nan=-1) > 0.2, 0.3, -0.2)
    got = boosting.boosted_path(spark, table(spark, pos, asset, target, x), ["u", "v", "w"], P).toPandas()
    want = np.array([target[p * 14 + int(a)] for p, a in zip(got.pos, got.asset)])
    assert np.corrcoef(got.score, want)[0, 1] > 0.9


def test_empty_and_bare(spark):
    none = spark.createDataFrame([], "pos long, asset string, target double, u double")
    assert boosting.boosted_path(spark, none, ["u"], P).count() == 0
    bare = spark.createDataFrame([(t, "a", 0.1, None) for t in range(60)], "pos long, asset string, target double, u double")
    assert boosting.boosted_path(spark, bare, ["u"], P).count() == 0


@pytest.mark.parametrize("bins", [2, 5])
def test_edges_are_quantiles(bins):
    assert len(boosting.Boost(bins=bins).edges()) == bins - 1 and np.all(np.diff(boosting.Boost(bins=bins).edges()) > 0)
