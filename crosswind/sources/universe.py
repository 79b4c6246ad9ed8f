"""Universes of symbols: text lists, scheduled index changes, daily snapshots and membership by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What an index change may do, and its required columns.
ACTIONS = ("add", "remove")
COLUMNS = ("effective_date", "index", "action", "symbol")


def symbol_of(x: Column) -> Column:
    return F.upper(F.trim(x))


def index_of(x: Column) -> Column:
    """Letters and digits of an index name in upper case."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Sorted distinct symbols of a text file with one a line and # comments."""
    line = symbol_of(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(line.alias("symbol")).where("symbol <> ''").distinct().orderBy("symbol")


def read_index_changes(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """Events (effective_date, index, action, symbol, source, note) of a CSV file.

    Raises ValueError for missing columns, unknown actions, bad dates or a symbol that is added
    and removed on one day.
    """
    raw = spark.read.csv(path, header=True, comment="#", mode="PERMISSIVE")
    if missing := [c for c in COLUMNS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: F.trim(F.col(c)) if c in raw.columns else F.lit("")
    events = raw.select(
        F.expr("try_to_date(trim(effective_date))").alias("effective_date"), index_of(F.col("index")).alias("index"), F.lower(F.trim("action")).alias("action"),
        symbol_of(F.col("symbol")).alias("symbol"), F.coalesce(text("source"), F.lit("")).alias("source"), F.coalesce(text("note"), F.lit("")).alias("note"),
    )
    if index is not None:
        events = events.where(F.col("index") == index_of(F.lit(index)))
    bad = events.where(F.col("effective_date").isNull() | ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)) | (F.coalesce("symbol", F.lit("")) == "")).limit(3).collect()
    if bad:
        raise ValueError(f"invalid index changes: {bad}")
    both = events.groupBy("effective_date", "index", "symbol").agg(F.count_distinct("action").alias("n")).where("n > 1").limit(3).collect()
    if both:
        raise ValueError(f"conflicting actions on one day: {both}")
    return events


def audited(seed: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """The events with ``status``: applied, noop_present, noop_absent or pending.

    Before an event its symbol is present as its last applied event says, or else as the seed (symbol) does.
    """
    key = Window.partitionBy("symbol").orderBy("effective_date", "action")
    due = F.col("effective_date") <= as_of
    known = seed.select("symbol", F.lit(True).alias("_seeded")).distinct()
    held = events.join(known, "symbol", "left").withColumn("_last", F.lag(F.when(due, F.col("action"))).over(key))
    before = F.coalesce(F.col("_last") == "add", F.col("_seeded"), F.lit(False))
    status = F.when(~due, "pending").when(F.col("action") == "add", F.when(before, "noop_present").otherwise("applied")).otherwise(F.when(before, "applied").otherwise("noop_absent"))
    return held.withColumn("status", status).drop("_last", "_seeded")


def symbols_as_of(seed: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """The seed's symbols with all due events applied."""
    last = events.where(F.col("effective_date") <= as_of).groupBy("symbol").agg(F.max_by("action", F.struct("effective_date", "action")).alias("action"))
    every = seed.select("symbol").distinct().withColumn("in_seed", F.lit(True)).join(last, "symbol", "full")
    return every.where(F.coalesce(F.col("action") == "add", F.col("in_seed"))).select("symbol")


def membership(dates: DataFrame, seed: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """(date, symbol, member): the seed from the first date on, changed from the first date on or after each due event.

    Dates and symbols are dimension tables; events meet dates by equality, so nothing is a range join.
    """
    days = dates.select("date").distinct()
    on = events.where(F.col("effective_date") <= as_of).select("symbol", "action", F.col("effective_date").alias("date"))
    # each event's first date on or after it: dates and event days in one order
    marks = days.withColumn("at", F.col("date")).unionByName(on.select("date").distinct().withColumn("at", F.lit(None).cast("date")))
    first = marks.groupBy("date").agg(F.max("at").alias("at")).withColumn("next", F.min("at").over(Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    moved = on.join(F.broadcast(first.select("date", "next")), "date").where("next is not null").groupBy("symbol", "next").agg(F.max_by("action", F.struct("date", "action")).alias("action"))
    symbols = seed.select("symbol").unionByName(moved.select("symbol")).distinct()
    start = seed.select("symbol", F.lit(True).alias("in_seed")).distinct()
    grid = days.crossJoin(symbols).join(start, "symbol", "left").join(moved.withColumnRenamed("next", "date"), ["symbol", "date"], "left")
    state = F.last(F.col("action") == "add", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date"))
    return grid.select("date", "symbol", F.coalesce(state, "in_seed", F.lit(False)).alias("member"))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(date, symbol) of the daily snapshot files ``yyyy-mm-dd.json`` with date and symbols."""
    raw = spark.read.schema("date string, listed_market string, symbols array<string>").json(f"{folder}/????-??-??.json", multiLine=True)
    return raw.select(F.to_date("date").alias("date"), F.explode("symbols").alias("symbol")).select("date", symbol_of(F.col("symbol")).alias("symbol")).distinct()


def snapshot_membership(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, symbol, member) by the last snapshot on or before each date; false before the first."""
    seen = snapshots.select("date").distinct().withColumn("shot", F.col("date"))
    days = dates.select("date").distinct().join(seen, "date", "full").withColumn("shot", F.last("shot", ignorenulls=True).over(Window.orderBy("date")))
    grid = days.join(dates.select("date").distinct(), "date", "left_semi").crossJoin(snapshots.select("symbol").distinct())
    held = snapshots.select(F.col("date").alias("shot"), "symbol", F.lit(True).alias("member"))
    return grid.join(held, ["shot", "symbol"], "left").select("date", "symbol", F.coalesce("member", F.lit(False)).alias("member"))


def listed_long(members: DataFrame, least: int) -> DataFrame:
    """Symbols that were members on at least so many dates."""
    return members.where("member").groupBy("symbol").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") >= least).select("symbol")


def active_equities(listing: DataFrame, market: str) -> DataFrame:
    """Symbols of a listing (symbol, listed_market, active, is_etf, is_closing_only) that can be held."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = listing.where((F.upper(F.trim("listed_market")) == market.upper()) & yes("active") & ~yes("is_etf") & ~yes("is_closing_only"))
    return own.select(symbol_of(F.col("symbol")).alias("symbol")).where("symbol rlike '^[A-Z]+$'").distinct()


def take_snapshot(spark: SparkSession, folder: str, day: str, market: str, symbols: DataFrame) -> bool:
    """Writes the day's snapshot unless there is one; true if it was written.  A universe is a list of symbols, thousands at most."""
    import json

    names = sorted(r["symbol"] for r in symbols.select("symbol").distinct().collect())
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{day}.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    stream = fs.create(path, False)
    stream.write(bytearray(json.dumps({"date": day, "listed_market": market, "symbols": names}).encode()))
    stream.close()
    return True


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def number(x: Column) -> Column:
    """The value as a finite double, else null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
