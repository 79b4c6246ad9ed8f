"""Panels kept as files, providers of panels, restatements and parity between two panels."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


class PanelSource(ABC):
    """What a provider of market data offers: symbols and bars (date, asset, open, high, low, close, volume)."""

    @abstractmethod
    def symbols(self) -> DataFrame: ...

    @abstractmethod
    def bars(self, start: str | None = None, end: str | None = None) -> DataFrame: ...


def between(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of an inclusive range of dates; the filter reaches the scan."""
    if start is not None:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    return bars if end is None else bars.where(F.col("date") <= F.lit(end).cast("date"))


class PanelStore(PanelSource):
    """Bars as Parquet by year, so that a range of dates reads its years only, with a small description beside them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, bars: DataFrame, source: str = "", files: int = 8) -> None:
        """Replaces the years that ``bars`` has; the others stay.  A year is written by several tasks, by asset.

        The description is of the whole store afterwards.
        """
        kept = bars.select("date", "asset", *FIELDS).withColumn("year", F.year("date"))
        dealt = kept.repartition("year", F.pmod(F.xxhash64("asset"), F.lit(files))).sortWithinPartitions("year", "asset", "date")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{self.folder}/bars")
        facts = self.bars().agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("asset").alias("assets"), F.count(F.lit(1)).alias("rows"))
        facts.select("*", F.lit(source).alias("source")).coalesce(1).write.mode("overwrite").json(f"{self.folder}/meta")

    def meta(self) -> dict:
        return self.spark.read.json(f"{self.folder}/meta").first().asDict()

    def symbols(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/bars").select("asset").distinct()

    def bars(self, start: str | None = None, end: str | None = None) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/bars")
        if start is not None:
            table = table.where(F.col("year") >= int(start[:4]))
        if end is not None:
            table = table.where(F.col("year") <= int(end[:4]))
        return between(table, start, end).drop("year")


class WideFolder(PanelSource):
    """Five wide Parquet files, one for each field, with a date column and a column for each asset."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def symbols(self) -> DataFrame:
        names = [c for c in self.spark.read.parquet(f"{self.folder}/close.parquet").columns if c != "date"]
        return self.spark.createDataFrame([(n,) for n in names], "asset string")

    def bars(self, start: str | None = None, end: str | None = None) -> DataFrame:
        out = None
        for field in FIELDS:
            wide = between(self.spark.read.parquet(f"{self.folder}/{field}.parquet"), start, end)
            long = melt(wide, ["date"], [c for c in wide.columns if c != "date"], "asset", field)
            out = long if out is None else out.join(long, ["date", "asset"], "full")
        return out.where(F.coalesce(*FIELDS).isNotNull())


def melt(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A row for each key and column, in one pass."""
    return wide.unpivot(keys, columns, name, value)


def widened(long: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """The inverse of ``melt`` for columns that are known beforehand, so that no pass looks for them."""
    return long.groupBy(*keys).pivot(name, columns).agg(F.first(value, ignorenulls=True))


class Synthetic(PanelSource):
    """A seeded random panel: returns of a market with a drift and a crash, betas, gaps and ranges.

    Every asset's path is a running sum of hashes of (seed, asset, date), so that Spark makes each row
    where it is needed and any number of assets costs no driver memory.
    """

    def __init__(self, spark: SparkSession, assets: int = 60, days: int = 900, seed: int = 7, start: str = "2020-01-01", crash: tuple[int, int] | None = None):
        self.spark, self.assets, self.days, self.seed, self.start, self.crash = spark, assets, days, seed, start, crash

    def symbols(self) -> DataFrame:
        return self.spark.range(self.assets).select(F.format_string("SYN%03d", "id").alias("asset"))

    def _normal(self, *key) -> F.Column:
        """A standard normal by the sum of twelve uniform hashes."""
        one = lambda k: (F.xxhash64(F.lit(self.seed), F.lit(k), *key) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
        return sum((one(k) for k in range(12)), F.lit(0.0)) - 6.0

    def bars(self, start: str | None = None, end: str | None = None) -> DataFrame:
        at = F.date_add(F.to_date(F.lit(self.start)), F.expr("CAST(t + 2 * FLOOR((t + weekday(DATE '" + self.start + "')) / 5) AS INT)"))
        days = self.spark.range(self.days).select(F.col("id").alias("t")).withColumn("date", at)
        drop = F.lit(0.0) if self.crash is None else F.when(F.col("t").between(*self.crash), -0.02).otherwise(0.0)
        market = days.withColumn("mkt", 0.0003 + 0.009 * self._normal(F.lit("m"), F.col("t")) + drop)
        names = self.symbols().withColumn("beta", 1.0 + 0.3 * self._normal(F.lit("b"), F.col("asset"))).withColumn("base", 40.0 + 10 * self._normal(F.lit("p"), F.col("asset")))
        every = names.crossJoin(F.broadcast(market))  # a row for each asset and date is the panel itself
        z = lambda name: self._normal(F.lit(name), F.col("asset"), F.col("t"))
        path = Window.partitionBy("asset").orderBy("t")
        rows = every.withColumn("close", F.greatest(F.col("base"), F.lit(5.0)) * F.exp(F.sum(F.col("beta") * F.col("mkt") + 0.015 * z("i")).over(path)))
        rows = rows.withColumn("open", F.coalesce(F.lag("close").over(path), F.col("close")) * F.exp(0.004 * z("g")))
        rows = rows.withColumn("high", F.greatest("open", "close") * (1 + 0.005 * F.abs(z("h")))).withColumn("low", F.least("open", "close") * (1 - 0.005 * F.abs(z("l")))).withColumn("volume", F.exp(13.0 + 0.4 * z("v") + 8 * F.abs("mkt")))
        return between(rows.select("date", "asset", *FIELDS), start, end)


def restated(old: DataFrame, fresh: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """(asset, worst): assets with two common dates at least whose closes differ by over the tolerance."""
    both = old.select("date", "asset", F.col("close").alias("a")).join(fresh.select("date", "asset", F.col("close").alias("b")), ["date", "asset"]).where("a is not null and b is not null")
    worst = F.max(F.abs(F.col("a") - F.col("b")) / (F.abs("a") + 1e-9))
    return both.groupBy("asset").agg(worst.alias("worst"), F.count(F.lit(1)).alias("dates")).where((F.col("dates") >= 2) & (F.col("worst") > tolerance)).select("asset", "worst")


def merged(old: DataFrame, fresh: DataFrame, mode: str = "incremental", tolerance: float = 0.002) -> DataFrame:
    """The panel after a refresh.

    full: the fresh rows alone.  incremental: old rows before the first fresh date, then the fresh ones.
    full_restatement: as incremental, but assets that were restated keep no old rows.
    """
    if mode == "full":
        return fresh.dropDuplicates(["date", "asset"])
    if mode not in ("incremental", "full_restatement"):
        raise ValueError(f"unknown mode {mode}")
    first = fresh.agg(F.min("date").alias("first"))
    before = old.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("date") < F.col("first"))).drop("first")  # one row
    if mode == "full_restatement":
        before = before.join(restated(old, fresh, tolerance).select("asset"), "asset", "left_anti").select(*old.columns)
    return before.unionByName(fresh.select(*old.columns).dropDuplicates(["date", "asset"]))


def parity(a: DataFrame, b: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row: assets only in a and only in b, common ones, the median of their worst differences, and how many are over the tolerance."""
    names = lambda x: x.select("asset").distinct()
    both = a.select("date", "asset", F.col("close").alias("x")).join(b.select("date", "asset", F.col("close").alias("y")), ["date", "asset"]).where("x is not null and y is not null")
    worst = both.groupBy("asset").agg(F.max(F.abs(F.col("x") - F.col("y")) / (F.abs("x") + 1e-9)).alias("worst"))
    one = worst.agg(F.count(F.lit(1)).alias("common"), F.percentile("worst", 0.5).alias("median_worst"), F.sum(F.when(F.col("worst") > tolerance, 1).otherwise(0)).alias("over_tolerance"))
    only = lambda x, y, c: names(x).join(names(y), "asset", "left_anti").agg(F.count(F.lit(1)).alias(c))
    return only(a, b, "only_a").crossJoin(only(b, a, "only_b")).crossJoin(one)


class Artifacts:
    """Tables, descriptions and reports of a run under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def frame(self, name: str, table: DataFrame, kind: str = "parquet") -> str:
        """A table in files of its own; what is there is replaced."""
        path = f"{self.folder}/{name}"
        writer = table.write.mode("overwrite")
        {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)
        return path

    def text(self, name: str, body: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        stream.write(bytearray(body.encode()))
        stream.close()
        return str(path)

    def meta(self, **facts) -> str:
        return self.text("meta.json", json.dumps(facts, indent=2, sort_keys=True, default=str))

    def report(self, body: str) -> None:
        self.text("report.md", body)
        self.text("LATEST.md", body)

    def run(self, tables: dict[str, DataFrame], **facts) -> dict[str, str]:
        """All tables of a run, and its description last, so that a run without one is not whole."""
        paths = {n: self.frame(n, t) for n, t in tables.items()}
        self.meta(tables=sorted(tables), **facts)
        return paths

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def morning_report(weights: DataFrame, before: DataFrame, budget: dict, metrics: dict, top: int = 10) -> str:
    """Markdown of a book: largest positions, largest changes, budget and metrics.  Only ``top`` rows of each reach the driver."""
    both = weights.select("asset", F.col("weight").alias("now")).join(before.select("asset", F.col("weight").alias("was")), "asset", "full").select("asset", F.coalesce("now", F.lit(0.0)).alias("now"), F.coalesce("was", F.lit(0.0)).alias("was"))
    moved = both.withColumn("change", F.col("now") - F.col("was"))
    large = moved.where("now <> 0").orderBy(F.desc(F.abs("now")), "asset").limit(top).collect()
    trades = moved.where("change <> 0").orderBy(F.desc(F.abs("change")), "asset").limit(top).collect()
    gross = weights.agg(F.coalesce(F.sum(F.abs("weight")), F.lit(0.0)).alias("g"), F.count(F.when(F.col("weight") != 0, 1)).alias("n")).first()
    lines = ["# Morning report", "", f"Positions {gross['n']}, gross {gross['g']:.2%}", "", "## Largest positions", ""]
    lines += [f"- {r['asset']}: {r['now']:.2%}" for r in large] + ["", "## Largest changes", ""] + [f"- {r['asset']}: {r['change']:+.2%}" for r in trades]
    for title, facts in (("Budget", budget), ("Metrics", metrics)):
        lines += ["", f"## {title}", ""] + [f"- {k}: {v:.4f}" if isinstance(v, (float, np.floating)) else f"- {k}: {v}" for k, v in facts.items()]
    return "\n".join(lines) + "\n"
