"""As-of joins and backfill against pandas, and a ledger with many writers at once."""

import datetime
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest

from crosswind.ledger import Ledger, put_if_absent
from crosswind.operators.asof import asof


def tables(seed=1, n=400, m=300):
    rng = np.random.default_rng(seed)
    key = lambda k: [None if x > 0.95 else "hot" if x > 0.5 else f"k{int(x * 12)}" for x in rng.random(k)]
    at = lambda k: [None if rng.random() < 0.04 else int(t) for t in rng.integers(0, 500, k)]
    left = pd.DataFrame({"key": key(n), "t": at(n), "x": rng.normal(size=n)})
    return pd.concat([left, left.iloc[:5]]), pd.DataFrame({"key": key(m), "t": at(m), "v": np.where(rng.random(m) < 0.1, None, rng.integers(0, 50, m)), "seq": rng.integers(0, 5, m)})


def brute(left, right, tolerance, strict, tie):
    out = []
    for _, l in left.iterrows():
        found = [r for _, r in right.iterrows() if l.key is not None and r.key == l.key and pd.notna(l.t) and pd.notna(r.t) and (r.t < l.t if strict else r.t <= l.t)]
        best = max(found, key=lambda r: (r.t, r.seq if tie else 0, -1 if pd.isna(r.v) else r.v), default=None)
        if best is not None and tolerance is not None and l.t - best.t > tolerance:
            best = None
        out.append((l.key, l.t, l.x, None if best is None else best.t, None if best is None or pd.isna(best.v) else best.v))
    return sorted(tuple(None if v is None or v != v else v for v in r) for r in map(lambda r: (r[2], *r), out))


@pytest.mark.parametrize("tolerance,strict,tie,stretch", [(None, False, None, 40), (25, False, "seq", 7), (None, True, "seq", 1000), (10, True, None, 1)])
def test_equal_to_brute_force(spark, tolerance, strict, tie, stretch):
    left, right = tables()
    plain = lambda f: [tuple(None if v is None or v != v else v for v in r) for r in f.astype(object).values.tolist()]
    a = spark.createDataFrame([(k, None if t is None else int(t), float(x)) for k, t, x in plain(left)], "key string, t long, x double")
    b = spark.createDataFrame([(k, None if t is None else int(t), None if v is None else int(v), int(s)) for k, t, v, s in plain(right)], "key string, t long, v long, seq int")
    got = asof(a, b, "key", "t", ["v"], stretch, tolerance, strict, tie).toPandas()
    assert got.columns.tolist() == ["key", "t", "x", "matched_t", "v"]
    mine = sorted(tuple(None if v is None or v != v else v for v in (r.x, r.key, r.t, r.x, r.matched_t, r.v)) for r in got.itertuples())
    assert mine == brute(left, right, tolerance, strict, tie)


def test_empty_sides(spark):
    a = spark.createDataFrame([("k", datetime.date(2024, 1, 2))], "key string, d date")
    none = spark.createDataFrame([], "key string, d date, v double")
    assert [tuple(r) for r in asof(a, none, "key", "d", ["v"], 10**12).collect()] == [("k", datetime.date(2024, 1, 2), None, None)]
    assert asof(a.where("1 = 0"), none, "key", "d", ["v"], 10**12).count() == 0
    b = spark.createDataFrame([("k", datetime.date(2020, 1, 2), 1.5), ("k", datetime.date(2024, 1, 3), 2.5)], "key string, d date, v double")
    assert [r.v for r in asof(a, b, "key", "d", ["v"], 86_400_000_000).collect()] == [1.5]


def test_no_two_writers_share_an_id_or_a_plan(spark, tmp_path):
    book = Ledger(spark, f"file://{tmp_path}/ledger")
    with ThreadPoolExecutor(8) as pool:
        owners = list(pool.map(lambda k: Ledger(spark, f"file://{tmp_path}/ledger").reserve("plan", f"owner{k}"), range(8)))
        runs = list(pool.map(lambda k: Ledger(spark, f"file://{tmp_path}/ledger").record_run(kind="rebalance", status="ok", strategy=f"s{k}"), range(8)))
        firsts = list(pool.map(lambda k: put_if_absent(spark, f"file://{tmp_path}/one", str(k)), range(32)))
    assert sum(owners) == 1 and book.table("reservations").count() == 1 and sorted(runs) == list(range(1, 9)) and sum(firsts) == 1
    winner = f"owner{owners.index(True)}"
    assert book.reserve("plan", winner) and not book.reserve("plan", "someone") and book.reserve("other", "someone")
    assert {r.id: r.strategy for r in book.runs().collect()}.keys() == set(runs) and book.runs().select("strategy").distinct().count() == 8


def test_backfill_goes_on_from_the_mark(spark, tmp_path):
    book = Ledger(spark, f"{tmp_path}/ledger")
    time = lambda m: datetime.datetime(2024, 1, 2, 10, m)
    quotes = spark.createDataFrame([("A", time(0), 10.0), ("A", time(5), 20.0), ("B", time(1), 50.0)], "symbol string, ts timestamp, price double")
    rows = [(time(2), "A", "buy", 1.0, 10.1, 1), (time(6), "A", "sell", 1.0, 19.8, 2), (time(6), "B", "buy", 1.0, 51.0, 3), (time(7), "C", "buy", 1.0, 5.0, 4)]
    fills = lambda k: spark.createDataFrame(rows[:k], "ts timestamp, symbol string, side string, qty double, fill_price double, transaction_id long")
    minute = 60_000_000
    assert [book.backfill(7, "b", fills(k), quotes, 3 * minute) for k in (2, 2, 3, 4, 4)] == [2, 0, 1, 1, 0]
    got = {r.transaction_id: r for r in book.fills().collect()}
    assert {k: None if r.slippage_bps is None else round(r.slippage_bps, 6) for k, r in got.items()} == {1: 100.0, 2: 100.0, 3: 200.0, 4: None} and got[2].reference_price == 20.0
    assert len({r.id for r in got.values()}) == 4
    assert book.backfill(8, "other", fills(4), quotes, 3 * minute, tolerance=2 * minute) == 0  # transactions are known already
