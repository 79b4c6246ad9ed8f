"""The run ledger as append-only Parquet tables; what is current is merged when it is read.

A write never changes a file: a status update, an equity value or a repeated fill is one more row,
and the readers take the worst or last one by key, so that repeated writers are safe and a lost executor's task can run
again.  What only one writer may have, an id or a plan, is a file that only one can create.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswind.operators.asof import asof

#: The tables' schemas, statuses that mean failure, and how bad a run's status is.
SCHEMAS = {
    "runs": "id long, ts timestamp, kind string, strategy string, config_hash string, data_last_date string, data_status string, status string, metrics string, output_dir string, forced boolean",
    "orders": "id long, ts timestamp, run_id long, broker string, broker_order_id long, dry_run boolean, symbol string, side string, qty double, est_price double, est_notional double, status string, reason string",
    "fills": "id long, ts timestamp, run_id long, broker string, broker_order_id long, transaction_id long, symbol string, side string, qty double, fill_price double, reference_price double, slippage_bps double, fees double, venue string, exec_id string",
    "equity": "d date, ts timestamp, shadow_nav double, paper_equity double, note string",
    "events": "id long, ts timestamp, level string, source string, message string",
    "reservations": "plan_hash string, ts timestamp, owner string",
}
FAILURES = ("error", "blocked", "rejected", "rejected_dry_run", "rejected_preflight", "cancelled", "expired", "removed", "partially removed", "skipped_after_failure")
SEVERITY = {"ok": 0, "planned": 0, "dry_run": 0, "awaiting_agent": 0, "evaluated": 0, "degraded": 1, "failed": 2}


def severity(status: Column) -> Column:
    key, out = F.lower(F.trim(F.coalesce(status, F.lit("ok")))), F.lit(0)
    for name, level in SEVERITY.items():
        if level:
            out = F.when(key == name, level).otherwise(out)
    return out


def failed(status: Column, error: Column | None = None) -> Column:
    bad = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*FAILURES)
    return bad | F.coalesce(error != "", F.lit(False)) if error is not None else bad


def inferred_status(results: DataFrame) -> DataFrame:
    """(run_id, status) of legs (run_id, status, error): failed after a skipped leg, degraded with any failure, else ok."""
    skipped = F.max(F.lower(F.trim(F.coalesce("status", F.lit("")))) == "skipped_after_failure")
    return results.groupBy("run_id").agg(F.when(skipped, "failed").when(F.max(failed(F.col("status"), F.col("error"))), "degraded").otherwise("ok").alias("status"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """One row a run: its first row with the worst status of those since the last forced one."""
    own = Window.partitionBy("id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    since = F.max(F.when(F.col("forced"), F.col("ts"))).over(own)
    live = runs.withColumn("_since", since).where(F.col("_since").isNull() | (F.col("ts") >= F.col("_since")))
    status = live.groupBy("id").agg(F.max_by("status", F.struct(severity(F.col("status")), -F.unix_micros("ts"))).alias("status"))
    first = runs.groupBy("id").agg(F.min_by(F.struct(*[c for c in runs.columns if c not in ("id", "status", "forced")]), "ts").alias("r")).select("id", "r.*")
    return first.join(status, "id")


def merged_fills(fills: DataFrame) -> DataFrame:
    """The first fill of each transaction; fills without one all stay."""
    known = fills.where("transaction_id is not null")
    first = known.groupBy("transaction_id").agg(F.min_by(F.struct(*fills.columns), "id").alias("f")).select("f.*")
    return first.unionByName(fills.where("transaction_id is null"))


def merged_equity(equity: DataFrame) -> DataFrame:
    """One row a day, the last known values, and the drift in basis points against the day before with both."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c)
    day = equity.groupBy("d").agg(last("shadow_nav"), last("paper_equity"), last("note"))
    both = F.when(F.col("shadow_nav").isNotNull() & F.col("paper_equity").isNotNull(), F.struct("shadow_nav", "paper_equity"))
    before = F.last(both, ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    drift = (F.col("paper_equity") / F.col("b.paper_equity") - F.col("shadow_nav") / F.col("b.shadow_nav")) * 1e4
    return day.withColumn("b", before).select("d", "shadow_nav", "paper_equity", (F.round(drift, 2) + 0.0).alias("drift_bps"), "note")


def unfilled(orders: DataFrame, fills: DataFrame, since: Column) -> DataFrame:
    """Sent orders since a time that have no fill."""
    sent = orders.where(F.col("broker_order_id").isNotNull() & (F.col("ts") >= since))
    return sent.join(fills.select("broker_order_id").where("broker_order_id is not null").distinct(), "broker_order_id", "left_anti").select("run_id", "broker_order_id", "symbol", "side", "qty", "est_price", "ts")


def health(orders: DataFrame, fills: DataFrame, equity: DataFrame, events: DataFrame, since: Column) -> DataFrame:
    """One row: open orders, fills, mean and worst slippage, worst drift and warnings since a time."""
    f = merged_fills(fills).where(F.col("ts") >= since)
    return (
        unfilled(orders, fills, since).agg(F.count(F.lit(1)).alias("open_orders"))
        .join(f.agg(F.count(F.lit(1)).alias("fills"), F.avg("slippage_bps").alias("mean_slippage_bps"), F.max(F.abs("slippage_bps")).alias("worst_slippage_bps")))
        .join(merged_equity(equity).where(F.col("d") >= since.cast("date")).agg(F.max(F.abs("drift_bps")).alias("worst_drift_bps")))
        .join(events.where((F.col("ts") >= since) & F.col("level").isin("warning", "critical", "error")).agg(F.count(F.lit(1)).alias("warnings")))
    )


def slippage_level(bps: Column, warning: float = 25.0, critical: float = 75.0, sandbox: Column | None = None) -> Column:
    """critical, warning or ok by the size of slippage; sandbox fills are never escalated."""
    level = F.when(F.abs(bps) >= critical, "critical").when(F.abs(bps) >= warning, "warning").otherwise("ok")
    return level if sandbox is None else F.when(sandbox, "ok").otherwise(level)


def put_if_absent(spark: SparkSession, path: str, body: str) -> bool:
    """Creates a file with this content unless one is there; of several writers at once exactly one is told True.

    On a mounted file system the whole file gets its name in one step that fails if the name is taken; elsewhere the store's own
    exclusive creation does.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        target = at.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        draft = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as f:
            f.write(body)
        try:
            os.link(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise e
    stream.write(bytearray(body.encode()))
    stream.close()
    return True


def content(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


class Ledger:
    """The tables of one folder."""

    #: Ids of rows that one call numbers: a claimed number times this, and on from there.
    BLOCK = 1 << 32

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """All rows; columns that older files lack are null."""
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        except Exception as e:  # no row was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame | list[dict]) -> None:
        """Rows as a frame or as dicts; absent columns are null, ts is now."""
        if not isinstance(rows, DataFrame):
            from pyspark.sql.types import _parse_datatype_string

            columns = _parse_datatype_string(SCHEMAS[name]).names
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], SCHEMAS[name])
        schema = self.spark.createDataFrame([], SCHEMAS[name]).dtypes
        held = {c for c in rows.columns}
        out = rows.select(*[(F.col(c) if c in held else F.lit(None)).cast(t).alias(c) for c, t in schema])
        out.withColumn("ts", F.coalesce("ts", F.current_timestamp())).write.mode("append").parquet(f"{self.folder}/{name}")

    def claimed(self, name: str) -> int:
        """The next number of a table, which no other writer gets."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_ids/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        taken = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        number = max((int(n) for n in taken if n.isdigit()), default=0) + 1
        while not put_if_absent(self.spark, f"{self.folder}/_ids/{name}/{number}", ""):
            number += 1
        return number

    def numbered(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with ids of their own, whatever task makes them."""
        return rows.withColumn("id", F.monotonically_increasing_id() + self.claimed(name) * self.BLOCK)

    def record_run(self, **run) -> int:
        run["id"] = self.claimed("runs")
        self.append("runs", [run])
        return run["id"]

    def update_run_status(self, run_id: int, status: str, worse_only: bool = True) -> None:
        if self.table("runs").where(F.col("id") == run_id).isEmpty():
            raise KeyError(f"run {run_id} is not in the ledger")
        self.append("runs", [{"id": run_id, "status": status, "forced": not worse_only}])

    def record_orders(self, run_id: int, broker: str, dry_run: bool, planned: DataFrame, results: DataFrame) -> None:
        """Planned legs (symbol, side, qty, est_price, est_notional, reason) with their results (symbol, order_id, status, error).

        Unless it is a dry run, a rebalance run gets the status that its legs show if that is not ok.
        """
        status = F.lit("planned") if dry_run else F.coalesce("status", F.lit("submitted"))
        legs = planned.join(results.select("symbol", F.col("order_id").alias("broker_order_id"), "status"), "symbol", "left")
        self.append("orders", self.numbered("orders", legs).withColumns({"run_id": F.lit(run_id), "broker": F.lit(broker), "dry_run": F.lit(dry_run), "status": status}))
        if not dry_run:
            shown = inferred_status(results.withColumn("run_id", F.lit(run_id))).first()
            if shown and shown["status"] != "ok" and self.runs().where((F.col("id") == run_id) & (F.col("kind") == "rebalance")).count():
                self.update_run_status(run_id, shown["status"], worse_only=False)

    def record_fills(self, run_id: int, broker: str, fills: DataFrame) -> None:
        """Fills whose transaction is new; those without a transaction are always recorded."""
        known = self.table("fills").select("transaction_id").where("transaction_id is not null").distinct()
        new = self.numbered("fills", fills.join(known, "transaction_id", "left_anti"))
        self.append("fills", new.withColumns({"run_id": F.lit(run_id), "broker": F.lit(broker)}))

    def backfill(self, run_id: int, broker: str, fills: DataFrame, quotes: DataFrame, stretch: int, tolerance: int | None = None) -> int:
        """Fills (ts, symbol, side, qty, fill_price, transaction_id) past what is recorded, with the price (symbol, ts, price) in force; how many.

        The broker's newest recorded fill is the mark: older ones aren't read again, those of its very time are told apart by transaction.
        Slippage is in basis points, positive where a buy paid or a sale got worse.  ``stretch`` and ``tolerance`` are microseconds.
        """
        mark = self.table("fills").where(F.col("broker") == broker).agg(F.max("ts")).first()[0]
        late = fills if mark is None else fills.where(F.col("ts") >= F.lit(mark))
        priced = asof(late, quotes, "symbol", "ts", ["price"], stretch, tolerance)
        sign = F.when(F.lower("side") == "sell", -1.0).otherwise(1.0)
        bps = F.when(F.col("price") > 0, sign * (F.col("fill_price") / F.col("price") - 1) * 1e4)
        before = self.table("fills").count()
        self.record_fills(run_id, broker, priced.withColumns({"reference_price": F.col("price"), "slippage_bps": bps}).drop("price", "matched_ts"))
        return self.table("fills").count() - before

    def record_equity(self, d: str, **values) -> None:
        import datetime

        self.append("equity", [{"d": datetime.date.fromisoformat(d), **values}])

    def record_event(self, level: str, source: str, message: str) -> None:
        self.append("events", [{"id": self.claimed("events"), "level": level, "source": source, "message": message}])

    def reserve(self, plan_hash: str, owner: str) -> bool:
        """True for the one owner of a plan, however often and whoever else asks."""
        path = f"{self.folder}/_reservations/{plan_hash}"
        if put_if_absent(self.spark, path, owner):
            self.append("reservations", [{"plan_hash": plan_hash, "owner": owner}])
            return True
        return content(self.spark, path) == owner

    def runs(self) -> DataFrame:
        return merged_runs(self.table("runs"))

    def fills(self) -> DataFrame:
        return merged_fills(self.table("fills"))

    def equity(self) -> DataFrame:
        return merged_equity(self.table("equity"))

    def recent_runs(self, n: int = 10) -> DataFrame:
        return self.runs().orderBy(F.desc("id")).limit(n)

    def open_warnings(self, since: Column) -> DataFrame:
        return self.table("events").where((F.col("ts") >= since) & F.col("level").isin("warning", "critical", "error"))

    def health(self, since: Column) -> DataFrame:
        return health(self.table("orders"), self.table("fills"), self.table("equity"), self.table("events"), since)
