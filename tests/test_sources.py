import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosswind import ledger
from crosswind.sources import calendar, store, universe
from crosswind.streaming import quotes


def test_universe_files(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("# base\naapl\n MSFT # big\n\nAAPL\n")
    (tmp_path / "events.csv").write_text("# changes\neffective_date,index,action,symbol,source,note\n2024-01-05,Nasdaq-100,add,zed,x,\n2024-02-01,NASDAQ100,remove,msft,x,out\n2024-03-01,NASDAQ100,add,AAPL,x,\n2024-09-01,NASDAQ100,add,LATE,x,\n2024-01-05,OTHER,add,QQQ,x,\n")
    seed = universe.read_symbols(spark, str(tmp_path / "seed.txt"))
    assert [r["symbol"] for r in seed.collect()] == ["AAPL", "MSFT"]
    events = universe.read_index_changes(spark, str(tmp_path / "events.csv"), "nasdaq 100")
    as_of = F.lit("2024-06-01").cast("date")
    assert {(r["symbol"], r["status"]) for r in universe.audited(seed, events, as_of).collect()} == {("ZED", "applied"), ("MSFT", "applied"), ("AAPL", "noop_present"), ("LATE", "pending")}
    assert sorted(r["symbol"] for r in universe.symbols_as_of(seed, events, as_of).collect()) == ["AAPL", "ZED"]
    dates = spark.createDataFrame([(dt.date(2024, 1, 4),), (dt.date(2024, 1, 8),), (dt.date(2024, 2, 2),)], "date date")
    got = {(str(r["date"]), r["symbol"]): r["member"] for r in universe.membership(dates, seed, events, as_of).collect()}
    assert got["2024-01-04", "ZED"] is False and got["2024-01-08", "ZED"] and got["2024-01-08", "MSFT"] and got["2024-02-02", "MSFT"] is False
    for bad in ("effective_date,action,symbol\n2024-01-01,add,A\n", "effective_date,index,action,symbol\n2024-01-01,I,buy,A\n", "effective_date,index,action,symbol\n2024-01-01,I,add,A\n2024-01-01,I,remove,A\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(ValueError):
            universe.read_index_changes(spark, str(tmp_path / "bad.csv"))


def test_snapshots(spark, tmp_path):
    one, two = (spark.createDataFrame([(s,) for s in names], "symbol string") for names in (["B", "A"], ["A", "C"]))
    folder = f"file://{tmp_path}"
    assert universe.take_snapshot(spark, folder, "2024-01-02", "XNAS", one) and universe.take_snapshot(spark, folder, "2024-01-04", "XNAS", two)
    assert not universe.take_snapshot(spark, folder, "2024-01-02", "XNAS", two)
    dates = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 5)], "date date")
    got = {(r["date"].day, r["symbol"]) for r in universe.snapshot_membership(universe.read_snapshots(spark, folder), dates).where("member").collect()}
    assert got == {(2, "A"), (2, "B"), (3, "A"), (3, "B"), (5, "A"), (5, "C")}
    listing = spark.createDataFrame([("aa", "xnas", True, False, False), ("BB", "XNAS", True, True, False), ("C.C", "XNAS", True, False, False), ("DD", "XNYS", True, False, None), ("EE", "XNAS", None, False, False)], "symbol string, listed_market string, active boolean, is_etf boolean, is_closing_only boolean")
    assert [r["symbol"] for r in universe.active_equities(listing, "xnas").collect()] == ["AA"]


def test_coercion(spark):
    got = spark.createDataFrame([(" Yes",), ("on",), ("2.5",), ("nan",), (None,), ("0",)], "x string").select(universe.truthy(F.col("x")).alias("t"), universe.number(F.col("x")).alias("n")).collect()
    assert [r["t"] for r in got] == [True, True, False, False, False, False] and [r["n"] for r in got] == [None, None, 2.5, None, None, 0.0]


def test_calendar(spark):
    closed = {str(r["d"]) for r in calendar.trading_days(spark, "2021-01-01", "2026-12-31").where("trading = 0 and w < 5").collect()}
    assert {"2026-04-03", "2026-06-19", "2026-07-03", "2026-11-26", "2026-12-25", "2022-06-20", "2024-03-29", "2021-12-24", "2023-01-02", "2025-01-20"} <= closed
    assert not {"2021-12-31", "2021-06-18", "2026-07-06", "2022-01-03"} & closed and sum(d < "2022" for d in closed) == 9 and sum("2023" <= d < "2024" for d in closed) == 10


def test_panel_store(spark, tmp_path):
    made = store.Synthetic(spark, assets=6, days=300, seed=3, crash=(200, 220))
    bars = made.bars()
    rows = bars.toPandas()
    assert len(rows) == 1800 and rows.date.map(lambda d: d.weekday()).max() < 5 and (rows.low <= rows[["open", "close"]].min(axis=1) + 1e-9).all() and (rows.high >= rows[["open", "close"]].max(axis=1) - 1e-9).all()
    wide = rows.pivot_table(index="date", columns="asset", values="close").sort_index()
    ret = wide.pct_change().mean(axis=1)
    assert ret.iloc[200:221].mean() < -0.01 < ret.iloc[:200].mean() and 0.001 < ret.iloc[:200].std() < 0.03
    kept = store.PanelStore(spark, f"file://{tmp_path}/p")
    kept.write(bars, "made")
    assert kept.meta()["rows"] == 1800 and kept.bars("2020-03-01", "2020-03-31").count() == bars.where("date between '2020-03-01' and '2020-03-31'").count() and kept.symbols().count() == 6
    assert "PartitionFilters: [isnotnull(year" in kept.bars("2021-01-01")._jdf.queryExecution().toString()
    for f in store.FIELDS:
        store.widened(bars, ["date"], "asset", f, sorted(wide.columns)).write.parquet(f"file://{tmp_path}/w/{f}.parquet")
    again = store.WideFolder(spark, f"file://{tmp_path}/w").bars()
    assert again.count() == 1800 and store.parity(bars, again).first()["over_tolerance"] == 0


def test_store_describes_all_of_itself(spark, tmp_path):
    """A later write of one year leaves the others there, and in the description."""
    bars = store.Synthetic(spark, assets=5, days=600, seed=3, start="2020-06-01").bars()
    kept = store.PanelStore(spark, f"file://{tmp_path}/p")
    kept.write(bars, "all")
    before = kept.meta()
    kept.write(bars.where("year(date) = 2021 and asset <> 'SYN002'"), "again")
    after = kept.meta()
    gone = bars.where("year(date) = 2021 and asset = 'SYN002'").count()
    assert (after["first"], after["last"], after["assets"], after["rows"], after["source"]) == (before["first"], before["last"], 5, before["rows"] - gone, "again")


def test_refresh(spark):
    rows = lambda days, k: [(dt.date(2024, 1, d), a, 10.0 * (k if a == "B" else 1)) for d in days for a in ("A", "B")]
    table = lambda r: spark.createDataFrame(r, "date date, asset string, close double")
    old, fresh = table(rows(range(1, 11), 1)), table(rows(range(8, 13), 0.5) + rows([12], 0.5))
    assert [r["asset"] for r in store.restated(old, fresh).collect()] == ["B"]
    got = store.merged(old, fresh)
    assert got.count() == 24 and got.where("date = '2024-01-09' and asset = 'B'").first()["close"] == 5.0
    assert store.merged(old, fresh, "full").count() == 10 and store.merged(old, fresh, "full_restatement").where("asset = 'B'").count() == 5
    one = store.parity(old, fresh.where("asset = 'B'")).first()
    assert (one["only_a"], one["only_b"], one["common"], one["over_tolerance"]) == (1, 0, 1, 1)


def test_artifacts(spark, tmp_path):
    out = store.Artifacts(spark, f"file://{tmp_path}/run")
    weights = spark.createDataFrame([("A", 0.6), ("B", 0.4)], "asset string, weight double")
    before = spark.createDataFrame([("A", 0.1), ("C", 0.5)], "asset string, weight double")
    out.run({"weights_today": weights}, strategy="x")
    out.frame("csv", weights, "csv")
    out.report(store.morning_report(weights, before, {"budget": 0.9}, {"days": 3}))
    assert out.read("weights_today").count() == 2 and json.loads((tmp_path / "run/meta.json").read_text())["strategy"] == "x"
    text = (tmp_path / "run/LATEST.md").read_text()
    assert "- A: 60.00%" in text and "- C: -50.00%" in text and "- budget: 0.9000" in text and "gross 100.00%" in text


def test_ledger(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    run = book.record_run(kind="rebalance", strategy="s", status="ok")
    other = book.record_run(kind="evaluate", strategy="s", status="degraded")
    book.update_run_status(other, "ok")
    assert {r["id"]: r["status"] for r in book.runs().collect()} == {run: "ok", other: "degraded"}
    with pytest.raises(KeyError):
        book.update_run_status(99, "ok")
    planned = spark.createDataFrame([("A", "buy", 5.0, 10.0, 50.0, "rebalance"), ("B", "sell", 1.0, 7.0, 7.0, "exit")], "symbol string, side string, qty double, est_price double, est_notional double, reason string")
    results = spark.createDataFrame([("A", 11, "filled", ""), ("B", 12, " Rejected", "")], "symbol string, order_id long, status string, error string")
    book.record_orders(run, "paper", False, planned, results)
    assert {r["id"]: r["status"] for r in book.runs().collect()}[run] == "degraded"
    book.update_run_status(run, "ok", worse_only=False)
    assert {r["id"]: r["status"] for r in book.runs().collect()}[run] == "ok"
    fills = spark.createDataFrame([(7, 11, "A", 30.0), (7, 11, "A", 31.0), (None, 11, "A", -80.0)], "transaction_id long, broker_order_id long, symbol string, slippage_bps double")
    book.record_fills(run, "paper", fills.limit(1))
    book.record_fills(run, "paper", fills)
    assert sorted(r["slippage_bps"] for r in book.fills().collect()) in ([-80.0, 30.0],)
    since = F.lit("2020-01-01").cast("timestamp")
    assert [r["symbol"] for r in ledger.unfilled(book.table("orders"), book.table("fills"), since).collect()] == ["B"]
    book.record_equity("2024-01-02", shadow_nav=1.0, paper_equity=100_000.0)
    book.record_equity("2024-01-03", shadow_nav=1.02)
    book.record_equity("2024-01-03", paper_equity=101_000.0, note="late")
    assert [r["drift_bps"] for r in book.equity().orderBy("d").collect()] == [None, -100.0]
    book.record_event("warning", "x", "y")
    one = book.health(since).first()
    assert (one["open_orders"], one["fills"], one["warnings"], one["worst_drift_bps"]) == (1, 2, 1, 100.0)
    assert book.recent_runs(1).first()["id"] == other and book.open_warnings(since).count() == 1
    assert book.reserve("h", "me") and not book.reserve("h", "you") and book.reserve("h", "me")
    levels = spark.createDataFrame([(10.0, False), (-30.0, False), (90.0, False), (90.0, True)], "b double, s boolean").select(ledger.slippage_level(F.col("b"), sandbox=F.col("s")).alias("l"))
    assert [r["l"] for r in levels.collect()] == ["ok", "warning", "critical", "ok"]


def test_account_streams(spark, tmp_path):
    raw = spark.createDataFrame([('{"type": "Order", "data": {"id": 1}, "timestamp": 1700000000000}',), ('{"action": "heartbeat", "status": "ok"}',)], "message string")
    got = {r["kind"]: r for r in quotes.notification(raw).collect()}
    assert got["event"]["type"] == "Order" and json.loads(got["event"]["data"]) == {"id": 1} and got["control"]["type"] == "heartbeat"
    marks, held = spark.createDataFrame([("A", 11.0), ("B", 5.0)], "symbol string, mark double"), spark.createDataFrame([("A", 2.0, 10.0, 8.0)], "symbol string, qty double, cost double, prev_close double")
    assert quotes.position_pnl(marks, held).first()[1:] == (22.0, 2.0, 0.375)
    notes = spark.createDataFrame([("o1", "Received", "2024-01-01 10:00:00"), ("o1", "Filled", "2024-01-01 10:01:00"), ("o2", "Live", "2024-01-01 10:00:00")], "order_id string, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    notes.write.parquet(f"{tmp_path}/notes")
    stream = quotes.watched(spark.readStream.schema(notes.schema).parquet(f"{tmp_path}/notes"), "1 seconds")
    run = stream.writeStream.outputMode("append").format("memory").queryName("watched_orders").trigger(processingTime="1 seconds").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(60):
            run.awaitTermination(1)
            rows = {(r["order_id"], r["status"], r["outcome"]) for r in spark.table("watched_orders").collect()}
            if len(rows) == 2:
                break
    finally:
        run.stop()
    assert rows == {("o1", "Filled", "done"), ("o2", "Live", "timeout")}


def test_daily_candles_drop_late_trades(spark, tmp_path):
    first = [("A", "2024-01-01 10:00:00", 1.0, 1.0), ("A", "2024-01-01 12:00:00", 3.0, 2.0), ("A", "2024-01-04 09:00:00", 9.0, 1.0)]
    late = [("A", "2024-01-01 11:00:00", 50.0, 5.0), ("A", "2024-01-08 10:00:00", 7.0, 1.0)]  # a batch's watermark holds from the next but one
    for i, rows in enumerate((first, [("A", "2024-01-04 10:00:00", 8.0, 1.0)], late, [("A", "2024-01-12 10:00:00", 7.0, 1.0)])):
        spark.createDataFrame(rows, "symbol string, ts string, price double, size double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/{i}")
    schema = spark.read.parquet(f"{tmp_path}/t/0").schema
    stream = quotes.candles(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/t"))
    run = stream.writeStream.outputMode("append").format("memory").queryName("day_candles").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    run.awaitTermination(120)
    got = {str(r["start"])[:10]: tuple(r)[2:] for r in spark.table("day_candles").collect()}
    assert got["2024-01-01"] == (1.0, 3.0, 1.0, 3.0, 3.0) and got["2024-01-04"] == (9.0, 9.0, 8.0, 8.0, 2.0)
    assert np.isfinite(list(got["2024-01-04"])).all()
