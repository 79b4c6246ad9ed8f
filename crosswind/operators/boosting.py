"""A learned score by boosted trees, refitted as dates go on, with partial histograms as Spark aggregates.

Features are z scores by date; each is kept as one byte: 0 where it is missing, else its bin between
quantiles of the normal distribution, which are known before any data are.  All refits grow side by side: a pass over the
table gives, for every refit, open node and feature, sums of residuals and weights by bin; Spark adds
them up, and the best split of each node is one row.  So the number of passes is trees times depth,
whatever the number of refits, and only splits reach the driver: at most ``2 ** depth`` for each tree and refit.

A refit at date t learns from dates before t - horizon only, newer ones heavier.  A date is scored by
the last refit up to it; a refit with too few rows doesn't happen, so the one before stays in force.

Defined results: rows with any known feature are learned from (if their target is known) and scored; a
missing value goes to the side of a split where it fits better, also where only missing and known are
split; ties go to the first feature, lowest bin, missing to the right; an empty table gives no score.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.sources.shared import keyed, stored


@dataclass(frozen=True)
class Boost:
    """Dates of training and between refits, the trees, and the least of rows and of a leaf's weight."""

    window: int = 252
    every: int = 42
    horizon: int = 21
    half_life: float = 63.0
    trees: int = 125
    depth: int = 4
    rate: float = 0.05
    ridge: float = 10.0
    least: int = 500
    leaf: float = 5.0
    bins: int = 32

    def edges(self) -> np.ndarray:
        return np.array([NormalDist().inv_cdf(k / self.bins) for k in range(1, self.bins)])


CODED = T.StructType([T.StructField("pos", T.LongType()), T.StructField("asset", T.StringType()), T.StructField("target", T.DoubleType()), T.StructField("codes", T.BinaryType())])
SPLITS = "at long, node int, feature int, cut int, missing_left boolean, left double, right double, value double"


class Tree:
    """Splits by node, the root 1 and the children of n at 2n and 2n + 1; nodes without a split bear a value."""

    def __init__(self, depth: int):
        self.feature, self.cut = np.full(2**depth, -1, "i4"), np.zeros(2**depth, "i4")
        self.missing_left, self.value = np.zeros(2**depth, bool), np.zeros(2 ** (depth + 1))

    def add(self, row) -> None:
        n = row["node"]
        self.feature[n], self.cut[n], self.missing_left[n] = row["feature"], row["cut"], row["missing_left"]
        if row["feature"] >= 0:
            self.value[2 * n], self.value[2 * n + 1] = row["left"], row["right"]
        self.value[n] = row["value"]

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The last node that each row reaches."""
        at, rows = np.ones(len(codes), "i8"), np.arange(len(codes))
        while True:
            open_ = at < len(self.feature)
            open_[open_] = self.feature[at[open_]] >= 0
            if not open_.any():
                return at
            here, mine = at[open_], rows[open_]
            code = codes[mine, self.feature[here]]
            left = np.where(code == 0, self.missing_left[here], code <= self.cut[here])
            at[open_] = 2 * here + ~left


def coded(rows: DataFrame, features: list[str], p: Boost) -> DataFrame:
    """``CODED`` of rows (pos, asset, target, features) with any known feature."""
    edges = p.edges()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1)
            codes = np.where(np.isfinite(x), np.searchsorted(edges, np.nan_to_num(x), "right") + 1, 0).astype("u1")
            kept = codes.any(1)
            flat = pa.array([c.tobytes() for c in codes[kept]], pa.binary())
            held = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([held.column("pos"), held.column("asset"), held.column("target"), flat], names=["pos", "asset", "target", "codes"])

    doubles = [F.col(f).cast("double").alias(f) for f in features]
    return rows.select(F.col("pos").cast("long").alias("pos"), F.col("asset").cast("string").alias("asset"), F.col("target").cast("double").alias("target"), *doubles).mapInArrow(run, CODED)


def refits(table: DataFrame, p: Boost) -> DataFrame:
    """(at): dates of refits: the first with enough rows, then every so many dates those with enough."""
    dates = table.groupBy("pos").agg(F.count("target").alias("n"))
    past = Window.orderBy("pos").rangeBetween(-p.window - p.horizon, -p.horizon - 1)  # one row a date
    able = dates.withColumn("n", F.coalesce(F.sum("n").over(past), F.lit(0))).where((F.col("pos") >= p.window + p.horizon) & (F.col("n") >= p.least))
    first = able.withColumn("first", F.min("pos").over(Window.partitionBy()))
    return first.where((F.col("pos") == F.col("first")) | (F.col("pos") % p.every == 0)).select(F.col("pos").alias("at"))


def _matrix(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), "u1").reshape(-1, n_features)


def _residuals(batch: pa.RecordBatch, anchors: list[int], models: dict[int, list[Tree]], growing: dict[int, Tree], n_features: int, p: Boost) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each refit that learns from the batch: its date, codes, nodes in the growing tree, residuals and weights."""
    codes, pos = _matrix(batch, n_features), batch.column("pos").to_numpy()
    target = batch.column("target").to_numpy(zero_copy_only=False).astype(float)
    for at in anchors:
        mine = np.flatnonzero((pos >= at - p.window - p.horizon) & (pos < at - p.horizon) & np.isfinite(target))
        if len(mine):
            own = codes[mine]
            told = np.zeros(len(mine))
            for tree in models[at]:
                told += tree.value[tree.nodes(own)]
            yield at, own, growing[at].nodes(own), target[mine] - told, 0.5 ** ((at - p.horizon - 1 - pos[mine]) / p.half_life)


def histograms(table: DataFrame, anchors: list[int], models: dict[int, list[Tree]], growing: dict[int, Tree], level: int, n_features: int, p: Boost) -> DataFrame:
    """(at, node, feature, g0.., w0..): weighted residuals and weights by bin of the nodes open at a level, added up over all tasks."""
    width, first = p.bins + 1, 2**level
    names = [f"{s}{k}" for s in "gw" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, codes, node, residual, weight in _residuals(batch, anchors, models, growing, n_features, p):
                inside = node >= first
                cells = ((node[inside, None] - first) * n_features + np.arange(n_features)) * width + codes[inside]
                size = first * n_features * width
                held = sums.setdefault(at, np.zeros((2, size)))
                for k, v in enumerate((weight * residual, weight)):
                    held[k] += np.bincount(cells.ravel(), np.repeat(v[inside], n_features), size)
        for at, held in sums.items():
            g, w = held.reshape(2, first, n_features, width)
            node, feature = (x.ravel() for x in np.indices((first, n_features)))
            some = w.sum(-1).ravel() > 0
            columns = [np.full(some.sum(), at), node[some] + first, feature[some], *g.reshape(-1, width)[some].T, *w.reshape(-1, width)[some].T]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * (2 * width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, kinds, strict=True)], names=["at", "node", "feature", *names])

    schema = "at long, node int, feature int, " + ", ".join(f"{n} double" for n in names)
    return table.mapInArrow(run, schema).groupBy("at", "node", "feature").agg(*[F.sum(n).alias(n) for n in names])


def splits(sums: DataFrame, p: Boost) -> DataFrame:
    """``SPLITS``: the best split of each node; feature -1 where none gains."""
    width = p.bins + 1

    def best(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("feature").to_numpy(), kind="stable")
        feature = part.column("feature").to_numpy()[order]
        g, w = (np.stack([part.column(f"{s}{k}").to_numpy() for k in range(width)], 1)[order] for s in "gw")
        total_g, total_w = g.sum(1, keepdims=True), w.sum(1, keepdims=True)
        # by feature, cut (the highest bin to the left) and side of the missing ones: right, then left
        left_g, left_w = (np.stack([c := np.cumsum(v[:, 1:], 1), c + v[:, :1]], 2) for v in (g, w))
        right_g, right_w = total_g[:, :, None] - left_g, total_w[:, :, None] - left_w
        score = lambda a, b: a * a / (b + p.ridge)
        gain = score(left_g, left_w) + score(right_g, right_w) - score(total_g, total_w)[:, :, None]
        gain = np.where((left_w >= p.leaf) & (right_w >= p.leaf), np.round(gain, 10), -np.inf)
        f, cut, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
        value = lambda a, b: float(p.rate * a / (b + p.ridge))
        own = value(total_g[f, 0], total_w[f, 0])
        wins = bool(gain[f, cut, side] > 0)
        row = {
            "at": part.column("at")[0].as_py(), "node": part.column("node")[0].as_py(), "feature": int(feature[f]) if wins else -1, "cut": int(cut) + 1, "missing_left": bool(side),
            "left": value(left_g[f, cut, side], left_w[f, cut, side]) if wins else own, "right": value(right_g[f, cut, side], right_w[f, cut, side]) if wins else own, "value": own,
        }
        into = pa.schema([("at", pa.int64()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("missing_left", pa.bool_()), ("left", pa.float64()), ("right", pa.float64()), ("value", pa.float64())])
        return pa.Table.from_pylist([row], schema=into)

    return sums.groupBy("at", "node").applyInArrow(best, SPLITS)


def fitted(table: DataFrame, anchors: list[int], n_features: int, p: Boost) -> dict[int, list[Tree]]:
    """The trees of each refit."""
    models: dict[int, list[Tree]] = {at: [] for at in anchors}
    for _ in range(p.trees if anchors else 0):
        growing = {at: Tree(p.depth) for at in anchors}
        for level in range(p.depth):
            found = splits(histograms(table, anchors, models, growing, level, n_features, p), p).collect()  # a row for each refit and open node
            for row in found:
                growing[row["at"]].add(row)
            if all(row["feature"] < 0 for row in found):
                break
        for at in anchors:
            models[at].append(growing[at])
    return models


def scored(table: DataFrame, models: dict[int, list[Tree]], n_features: int) -> DataFrame:
    """(pos, asset, score) of the dates from the first refit on."""
    anchors = np.array(sorted(models), "i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, pos = _matrix(batch, n_features), batch.column("pos").to_numpy()
            last = np.searchsorted(anchors, pos, "right") - 1
            score = np.zeros(len(pos))
            for k in np.unique(last[last >= 0]):
                mine = np.flatnonzero(last == k)
                for tree in models[int(anchors[k])]:
                    score[mine] += tree.value[tree.nodes(codes[mine])]
            held = pa.array(last >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("pos").filter(held), batch.column("asset").filter(held), pa.array(score).filter(held)], names=["pos", "asset", "score"])

    return table.mapInArrow(run, "pos long, asset string, score double")


def digest(table: DataFrame, features: list[str], p: Boost) -> str:
    """A key of everything that a score depends on: two sums of row hashes, the number of rows, features and parameters."""
    row = ("pos", "asset", "target", "codes")
    sums = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string").alias(f"h{seed}") for seed in (1, 2)]).first()
    return hashlib.sha256(json.dumps([*map(str, sums), features, asdict(p)], sort_keys=True).encode()).hexdigest()[:32]


def boosted_path(spark: SparkSession, rows: DataFrame, features: list[str], p: Boost = Boost()) -> DataFrame:
    """(pos, asset, score) of rows (pos, asset, target, features), the score a z score of its date.

    ``pos`` is the date's number and ``target`` the rank of the forward return less a half.  Scores are stored under a
    digest of the rows and parameters, so that strategies that share both learn once.
    """
    table = stored(spark, coded(rows, features, p), "coded")

    def make() -> DataFrame:
        models = fitted(table, [r["at"] for r in refits(table, p).orderBy("at").collect()], len(features), p)  # dates of refits
        by = Window.partitionBy("pos")
        z = (F.col("score") - F.avg("score").over(by)) / (F.stddev_samp("score").over(by) + F.lit(1e-12))
        return scored(table, models, len(features)).withColumn("score", z)

    return keyed(spark, make, f"boosted-{digest(table, features, p)}")
