import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosswind.operators import book, construct, pnl
from crosswind.plans.blend_ctes import share_ctes
from crosswind.plans.panel_queries import Dialect
from crosswind.streaming import quotes


def test_simplex_is_the_nearest_point():
    """Against a search over shifts: the projection is a clipped shift, and no other shift has the sum."""
    rng = np.random.default_rng(12)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        v, lo = rng.normal(size=n), rng.uniform(0, 0.1, n)
        hi = lo + rng.uniform(0.05, 0.5, n)
        total = float(rng.uniform(lo.sum(), hi.sum()))
        got = book.project_capped_simplex(v, total, lo, hi)
        assert abs(got.sum() - total) < 1e-9 and (got >= lo - 1e-12).all() and (got <= hi + 1e-12).all()
        other = np.clip(v - np.linspace(-3, 3, 20_001)[:, None], lo, hi)
        near = other[np.abs(other.sum(axis=1) - total).argmin()]
        assert np.abs(got - near).max() < 1e-3
    assert book.project_capped_simplex(np.zeros(2), 3.0, np.zeros(2), np.ones(2)).tolist() == [1, 1]


def test_latch_follows_its_rule():
    """On from the first value over the trip level to the first under the rearm level; gaps keep the state, at the start it is off."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        dd = rng.uniform(0, 0.3, 60)
        dd[rng.random(60) < 0.2] = np.nan
        got, on = book.kill_latch(dd, 0.2, 0.08), False
        for x, g in zip(dd, got):
            if x > 0.2:
                on = True
            elif on and x < 0.08:
                on = False
            assert g == on
    assert book.kill_latch(np.array([np.nan, 0.07, np.nan, 0.31, np.nan, 0.12, 0.079, 0.25, 0.01]), 0.2, 0.08).tolist() == [0, 0, 0, 1, 1, 1, 0, 1, 0]


def test_parity_by_halves_of_the_linkage_order():
    x = np.random.default_rng(0).normal(size=(200, 6)) * np.array([1, 1, 2, 2, 0.5, 1])
    x[:, 1] = x[:, 0] + 0.01 * x[:, 1]
    w = construct.parity(x)
    assert abs(w.sum() - 1) < 1e-9 and (w > 0).all() and abs(w[0] - w[1]) / w[0] < 0.1 and w[4] > w[2]
    two = x[:, [2, 3, 5]]
    order = book.single_linkage(np.sqrt((1 - np.corrcoef(two, rowvar=False)) / 2))
    iv = 1 / two.var(axis=0)
    want, (a, b, c) = np.zeros(3), order
    pair = 1 / (iv[b] + iv[c])
    want[a] = pair / (1 / iv[a] + pair)
    want[b], want[c] = (1 - want[a]) * iv[b] / (iv[b] + iv[c]), (1 - want[a]) * iv[c] / (iv[b] + iv[c])
    assert np.abs(construct.parity(two) - want).max() < 1e-9
    assert construct.parity(x[:30]) is None and construct.parity(x[:, :2]) is None


def test_cluster_caps_spread_once():
    x = np.random.default_rng(1).normal(size=(150, 5))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    got = construct.capped_clusters(np.array([0.4, 0.3, 0.2, 0.1]), x[:, :4], 0.5, 0.7)
    assert np.allclose(got, [0.4 * 5 / 7, 0.3 * 5 / 7, 0.2 * 5 / 3, 0.1 * 5 / 3])
    assert construct.capped_clusters(np.array([0.4, 0.3, 0.3]), x[:20, :3], 0.5, 0.7).tolist() == [0.4, 0.3, 0.3]
    assert construct.clusters(np.array([[1, 0, 1, 0], [0, 1, 0, 0], [1, 0, 1, 1], [0, 0, 1, 1]], bool)).tolist() == [0, 1, 0, 0]


def test_tilt_keeps_the_mass():
    base, score = np.array([0.5, 0.3, 0.1]), np.array([0.0, 1.0, 3.0])
    z = (score - score.mean()) / score.std()
    assert np.allclose(construct.tilted(base, score, 0.6), 0.4 * base + 0.6 * 0.9 * np.exp(z) / np.exp(z).sum())
    assert construct.tilted(base, score, 0).tolist() == base.tolist()


def _panel(days=150, assets=24, seed=2):
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range("2023-01-02", periods=days)
    frame = lambda x: pd.DataFrame(x, index=dates, columns=[f"A{i:02d}" for i in range(assets)])
    ret = rng.normal(0, 0.01, (days, assets))
    ret[:, 1], ret[:, 2] = ret[:, 0] + 0.001 * ret[:, 1], ret[:, 0] - 0.002 * ret[:, 2]
    return frame(rng.normal(size=(days, assets))), frame(ret), frame(np.ones((days, assets)))


def _table(spark, books):
    """Rows of several strategies: name -> (score, returns, liquid, cap)."""
    plain = lambda v: None if np.isnan(v) else float(v)
    rows = [(s, d.date(), a, *(plain(f.loc[d, a]) for f in frames)) for s, frames in books.items() for d in frames[0].index for a in frames[0].columns]
    return spark.createDataFrame(rows, "strategy_id string, date date, asset string, score double, ret double, liquid double, cap_mult double")


def _weights(got, strategy, score):
    own = got[got.strategy_id == strategy]
    return own.pivot_table(index="date", columns="asset", values="weight").reindex(index=[d.date() for d in score.index], columns=score.columns).fillna(0.0).to_numpy()


def brute_book(score, ret, liquid, cap, p):
    """Every date over all assets at once, from dense frames; the projection by bisection."""

    def fit(v, lo, hi):
        if hi.sum() <= 1 or lo.sum() >= 1:
            return hi if hi.sum() <= 1 else lo
        a, b = (v - hi).min(), (v - lo).max()
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if np.clip(v - m, lo, hi).sum() > 1 else (a, m)
        return np.clip(v - a, lo, hi)

    smooth = score.rolling(p.smooth, min_periods=1).mean().where(liquid > 0)
    spread = smooth.std(axis=1)
    z = ((spread - spread.expanding(63).mean()) / spread.expanding(63).std()).fillna(0)
    cap, n = cap.fillna(0).clip(0, 1).to_numpy(), score.shape[1]
    held, out = np.zeros(n), []
    for t in range(len(score)):
        s = smooth.iloc[t].to_numpy()
        able = [j for j in range(n) if np.isfinite(s[j]) and cap[t, j] > 0]
        if len(able) >= p.least_seats:
            k = min(len(able), max(p.least_seats, min(p.most_seats, round(p.seats - p.seat_slope * z.iloc[t]))))
            best = sorted(able, key=lambda j: (-s[j], j))[:k]
            own = s[best]
            base = (own - own.min() + 1e-6) / (own - own.min() + 1e-6).sum()
            if p.mode != "score" and t >= 63:
                even = construct.parity(ret.iloc[max(0, t - 126) : t, best].to_numpy())
                base = even if p.mode == "hrp" else (base + even) / 2
            e = np.exp((own - own.mean()) / own.std())
            want, lo, hi = np.zeros(n), np.zeros(n), np.zeros(n)
            want[best] = (1 - p.tilt) * base + p.tilt * e / e.sum()
            hi[best] = p.most * cap[t, best]
            lo[best] = np.minimum(p.least, hi[best])
            want = fit(want, lo, hi)
            if t >= p.cluster_window:
                corr = np.corrcoef(ret.iloc[t - p.cluster_window : t, best].to_numpy(), rowvar=False)
                groups = []
                for i in range(k):
                    near = [g for g in groups if any(corr[i, j] > p.cluster_corr for j in g)]
                    groups = [g for g in groups if g not in near] + [{i}.union(*near)]
                cut = want.copy()
                large = [[best[i] for i in g] for g in groups if len(g) > 1 and want[[best[i] for i in g]].sum() > p.cluster_cap]
                rest = [j for j in best if not any(j in g for g in large)]
                for g in large:
                    cut[g] *= p.cluster_cap / want[g].sum()
                if large:
                    cut[rest] *= 1 + (want.sum() - cut.sum()) / cut[rest].sum()
                want = fit(cut, lo, hi)
            if t:
                want = fit(held, lo, hi) if np.abs(want - held).sum() < p.band and held.any() else fit(p.speed * want + (1 - p.speed) * held, lo, hi)
            held = want
        out.append(held)
    return np.array(out)


@pytest.mark.parametrize("mode", ["score", "hrp", "blend"])
def test_unit_books(spark, mode):
    """Several strategies in one plan, against a loop over dense frames; over two stretches of dates and with clusters to cut."""
    score, ret, one = _panel()
    p = construct.Book(seats=18, least_seats=12, most_seats=22, mode=mode, cluster_window=70, cluster_cap=0.2)
    gap = score.copy()
    gap.iloc[60:70, 5:] = np.nan  # too few valid scores carry the book on
    gap.iloc[0] = np.nan
    shut, half = one.copy(), one.copy()
    shut["A03"] = 0.0  # illiquid
    half["A05"], half["A06"] = 0.0, 0.3  # new
    slow = pd.DataFrame(np.tile(score.iloc[0].to_numpy(), (len(score), 1)), index=score.index, columns=score.columns) + 1e-4 * score  # mostly not traded
    books = {"all": (score, ret, one, one), "gap": (gap, ret, one, one), "shut": (score, ret, shut, half), "slow": (slow, ret, one, one)}
    got = construct.unit_weights(_table(spark, books).repartition(6), p).toPandas()
    for s, frames in books.items():
        mine, want = _weights(got, s, score), brute_book(*frames, p)
        assert np.abs(mine - want).max() < 1e-7, (s, np.abs(mine - want).max(axis=1).argmax())
    assert _weights(got, "shut", score)[:, 3].max() == 0 == _weights(got, "shut", score)[:, 5].max() and np.abs(np.diff(_weights(got, "gap", score)[62:70], axis=0)).max() == 0
    every = _weights(got, "all", score)
    assert np.allclose(every.sum(axis=1), 1, atol=1e-9) and every.max() <= p.most + 1e-9
    told = got[got.strategy_id == "all"].groupby("date").agg({"turnover": "first", "seats": "first", "held": "first"})
    assert told.seats.between(12, 22).all() and np.allclose(np.abs(np.diff(every, axis=0)).sum(axis=1), told.turnover[1:], atol=1e-9) and got[got.strategy_id == "slow"].held.max() == 1
    # nothing later counts
    cut = construct.unit_weights(_table(spark, {"all": tuple(f[:100] for f in books["all"])}), p).toPandas()
    assert np.abs(_weights(cut, "all", score[:100]) - every[:100]).max() < 1e-12


def test_unit_books_of_numbers_and_nothing(spark):
    score, ret, one = _panel(40, 16)
    rows = _table(spark, {"x": (score, ret, one, one)}).selectExpr("1 AS strategy_id", "date", "CAST(substr(asset, 2) AS BIGINT) AS asset", "score", "ret", "liquid", "cap_mult")
    p = construct.Book(seats=12, least_seats=10, most_seats=14)
    got = construct.unit_weights(rows, p).toPandas()
    want = brute_book(score, ret, one, one, p)
    assert np.abs(got.pivot_table(index="date", columns="asset", values="weight").reindex(columns=range(16)).fillna(0.0).to_numpy() - want).max() < 1e-7
    assert construct.unit_weights(rows.where("1 = 0"), p).count() == 0


def brute_shares(net, b):
    """A date at a time in pandas; bounds are met by moving what is too much again and again."""
    net = net[[i for i, _ in b.parts]]
    fixed = pd.Series(b.shares())[net.columns]

    def box(raw):
        w = (raw / raw.sum()).clip(b.least, b.most)
        for _ in range(50):
            room = (b.most - w if w.sum() < 1 else w - b.least).clip(lower=0)
            if room.sum() > 0:
                w = (w + (1 - w.sum()) * room / room.sum()).clip(b.least, b.most)
        return w

    out, now, past = [], fixed, net.shift(1)
    for t in range(len(net)):
        before, want = past.iloc[max(0, t - b.window + 1) : t + 1], fixed
        vol = before.std() * 252**0.5
        if (before.count() >= b.history).all():
            raw = 1 / vol
            if b.method == "alpha_risk":
                mean = past.iloc[: t + 1].ewm(halflife=max(10, b.window // 3), adjust=False).mean().iloc[-1] * 252
                sample = past.iloc[max(0, t - b.window) : t].dropna(how="all")
                near = (sample.corr().abs().sum() - 1) / (len(fixed) - 1) if len(sample) >= b.history else None
                raw = raw * np.exp(b.alpha * (mean / vol).clip(-2.5, 2.5)) * (1 if near is None else 1 / np.sqrt(0.5 + near.clip(0, 1)))
            want = box(raw)
        now = fixed if b.method == "fixed" else box(b.speed * want + (1 - b.speed) * now)
        out.append(now)
    return pd.DataFrame(out, index=net.index)


def test_blends(spark):
    rng = np.random.default_rng(4)
    dates = pd.bdate_range("2022-01-03", periods=220)
    net = pd.DataFrame(rng.normal(0.0003, [0.004, 0.01, 0.02, 0.0015], (220, 4)) + rng.normal(0, 0.003, (220, 1)), index=dates, columns=["a", "b", "c", "d"])
    three, four = (("a", 1.0), ("b", 1.0), ("c", 2.0)), tuple((x, 1.0) for x in "abcd")
    blends = [
        construct.Blend("f", (("a", 0.6), ("b", 0.4))), construct.Blend("v", three, "inverse_vol", speed=1.0), construct.Blend("t", three, "alpha_risk", alpha=0.4), construct.Blend("u", four, "alpha_risk", least=0.08, most=0.5),
        construct.Blend("w", four, "inverse_vol", window=60, history=30, least=0.1, most=0.3),
    ]
    table = spark.createDataFrame([(s, d.date(), float(v)) for d, r in net.iterrows() for s, v in r.items()], "strategy_id string, date date, net double")
    ctes_ = share_ctes(Dialect("spark"), "pnl", blends)
    got = spark.sql("WITH pnl AS (SELECT * FROM {t}),\n" + ",\n".join(f"{n} AS ({q})" for n, q in ctes_) + "\nSELECT * FROM shares", t=table).toPandas()
    for b in blends:
        mine = got[got.blend == b.name].pivot(index="date", columns="strategy_id", values="share")
        want = brute_shares(net, b)
        assert np.abs(mine[want.columns].to_numpy() - want.to_numpy()).max() < 1e-8, b.name
        assert np.allclose(mine.sum(axis=1), 1) and mine.to_numpy().max() <= b.most + 1e-9
    for bad in (construct.Blend("x", (("a", 0.5),)), construct.Blend("x", (("a", 0.5), ("b", 0.4))), construct.Blend("x", three, "other"), construct.Blend("x", three, "inverse_vol", least=0.4), construct.Blend("x", (("a", 1.0), ("a", 1.0)), "inverse_vol")):
        with pytest.raises(ValueError):
            bad.validate()


def test_blended_books_are_costed_anew(spark):
    """P&L of sparse books against dense frames, with a part that comes and goes; scores over the shares that have one; stops."""
    rng = np.random.default_rng(6)
    dates, assets = pd.bdate_range("2022-01-03", periods=30), list("pqrs")
    ret = pd.DataFrame(rng.normal(0, 0.02, (30, 4)), index=dates, columns=assets)
    ret.iloc[4, 2] = np.nan
    books = {s: pd.DataFrame(np.where(rng.random((30, 4)) < 0.5, rng.uniform(0, 0.4, (30, 4)), 0.0), index=dates, columns=assets) for s in "ab"}
    books["a"].iloc[10:14] = 0.0
    share = {"a": 0.7, "b": 0.3}
    rows = [(s, d.date(), a, float(w)) for s, f in books.items() for d, r in f.iterrows() for a, w in r.items() if w]
    weights = spark.createDataFrame(rows, "strategy_id string, date date, asset string, weight double")
    shares = spark.createDataFrame([("m", d.date(), s, x) for d in dates for s, x in share.items()], "blend string, date date, strategy_id string, share double")
    returns = spark.createDataFrame([(d.date(), a, None if np.isnan(v) else float(v)) for d, r in ret.iterrows() for a, v in r.items()], "date date, asset string, ret double")
    got = pnl.backtest(construct.blended(weights, shares), returns, "blend").toPandas().sort_values("date").set_index("date")
    w = sum(books[s] * x for s, x in share.items())
    was = w.shift(1)
    turnover, exposure = w.diff().abs().sum(axis=1), was.abs().sum(axis=1)
    net = (was * ret).sum(axis=1) - turnover * 3e-4 + (1 - exposure).clip(lower=0) * 0.04 / 252
    assert np.abs(got.net_ret.to_numpy() - net.to_numpy()).max() < 1e-12 and np.abs(got.turnover.to_numpy() - turnover.to_numpy()).max() < 1e-12 and got.turnover.iloc[0] == 0
    day = dates[0].date()
    scores = spark.createDataFrame([("a", day, "p", 1.0), ("b", day, "p", 2.0), ("a", day, "q", 3.0), ("b", day, "q", None)], "strategy_id string, date date, asset string, score double")
    assert {r.asset: round(r.score, 9) for r in construct.blended_scores(scores, shares).collect()} == {"p": 1.3, "q": 3.0}
    kills = spark.createDataFrame([("a", day, 0), ("b", day, 1)], "strategy_id string, date date, kill int")
    assert {r.date: r.kill for r in construct.blended_kill(kills, shares).collect()}[day] == 1


def test_markov():
    m = construct.markov(np.array([[8, 2, 0], [4, 6, 0], [0, 0, 0]], float), 3)
    assert np.allclose(m["matrix"], [[0.8, 0.2, 0], [0.4, 0.6, 0], [0, 0, 1]]) and np.allclose(m["forecast"], m["matrix"] @ m["matrix"] @ m["matrix"])
    assert np.allclose(m["stationary"] @ m["matrix"], m["stationary"]) and np.allclose(m["dwell"][:2], [5, 2.5]) and np.isnan(m["dwell"][2])
    assert abs(m["entropy"][0] + 0.8 * np.log2(0.8) + 0.2 * np.log2(0.2)) < 1e-12


def test_book_and_ewm(spark):
    dates = pd.date_range("2024-01-01", periods=30).date
    rng = np.random.default_rng(1)
    rows = [(s, d, a, float(rng.normal())) for s in ("a", "b") for d in dates for a in range(20)]
    got = book.sequential_book(spark.createDataFrame(rows, "strategy_id string, date date, asset int, score double")).toPandas()
    sums = got.groupby(["strategy_id", "date"]).weight.sum()
    assert ((sums > 0.95) & (sums < 1.0 + 1e-9)).all() and got.weight.max() <= 0.2 + 1e-9
    panel = spark.createDataFrame([(1, d, float(i) if i % 4 else None) for i, d in enumerate(dates)], "asset int, date date, c double")
    out = book.ewm_by_asset(panel, "c", 0.2).toPandas().sort_values("date")
    assert np.isnan(out["ewm"].iloc[0]) and out["ewm"].iloc[1] == 1.0


def test_deflated_sharpe():
    assert book.deflated_sharpe(0.2, 500, 0.0, 0.0, 1, 0.05)[1] == "PASS"
    assert book.deflated_sharpe(-0.1, 500, 0.0, 0.0, 20, 0.05)[1] == "FAIL"


def test_streams(spark, tmp_path):
    frames = spark.createDataFrame([('["Quote", ["A", 1, 2, "B", 3, 4]]',), ('["Trade", ["A", 5]]',)], "frame string")
    got = quotes.parsed(frames, {"Quote": ["symbol", "bid", "ask"], "Trade": ["symbol", "price"]}).collect()
    assert sorted((r["type"], r["event"]["symbol"]) for r in got) == [("Quote", "A"), ("Quote", "B"), ("Trade", "A")]
    rows = spark.createDataFrame([("A", "2024-01-01 10:00:00", 1.0, 2.0, 9.0), ("A", "2024-01-01 11:00:00", 2.0, 3.0, 9.0), ("B", "2024-01-01 10:00:00", 0.0, 3.0, 7.0)], "symbol string, ts string, bid double, ask double, last double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = quotes.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_quotes").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r["symbol"], r["mark"]) for r in spark.table("latest_quotes").collect()} == {("A", 2.5), ("B", 7.0)} == {(r["symbol"], r["mark"]) for r in quotes.latest(rows).collect()}


def test_performance_equals_pandas(spark):
    """All measures of two books, one with gaps, and one with too short a history."""
    rng = np.random.default_rng(3)
    dates = pd.bdate_range("2022-01-03", periods=120)
    bench = pd.Series(rng.normal(0.0004, 0.01, 120), index=dates)
    books = {"a": 0.6 * bench + rng.normal(0.0003, 0.006, 120), "b": pd.Series(rng.normal(-0.001, 0.02, 120), index=dates), "short": bench[:15]}
    books["b"].iloc[[4, 9]] = np.nan
    bench.iloc[30] = np.nan
    plain = lambda v: None if np.isnan(v) else float(v)
    rows = spark.createDataFrame([(k, d.date(), plain(v), plain(bench[d])) for k, x in books.items() for d, v in x.items()], "book string, date date, net double, bench double")
    got = pnl.performance(rows.repartition(5), "book").toPandas().set_index("book")
    assert got.error["short"] == "insufficient history" and got.days["short"] == 15 and np.isnan(got.sharpe["short"]) and got.error[["a", "b"]].isna().all()
    for k in "ab":
        r = books[k].dropna()
        m = pd.concat([r, bench], axis=1, join="inner").dropna()
        p, b = m.iloc[:, 0], m.iloc[:, 1]
        year = lambda x: (1 + x).prod() ** (252 / len(x)) - 1
        dd = ((1 + r).cumprod() / (1 + r).cumprod().cummax() - 1).min()
        beta = p.cov(b) / b.var()
        want = {
            "days": len(r), "ann_return": year(r), "ann_vol": r.std() * 252**0.5, "sharpe": r.mean() / r.std() * 252**0.5, "sortino": r.mean() / r[r < 0].std() * 252**0.5, "max_dd": dd, "calmar": year(r) / abs(dd), "win_rate": (r > 0).mean(), "worst_day": r.min(), "best_day": r.max(),
            "skew": r.skew(), "kurtosis": r.kurt(), "tail_ratio": abs(r.quantile(0.95)) / abs(r.quantile(0.05)), "active_return": year(p - b), "active_vol": (p - b).std() * 252**0.5, "info_ratio": (p - b).mean() / (p - b).std() * 252**0.5, "bench_return": year(b), "beta": beta,
            "alpha": (p - beta * b).mean() * 252, "correlation": p.corr(b), "up_capture": p[b > 0].mean() / b[b > 0].mean(), "down_capture": p[b < 0].mean() / b[b < 0].mean(),
        }
        for name, value in want.items():
            assert abs(got.loc[k, name] - value) < 1e-6 * max(1, abs(value)), (k, name)
