"""Quality classifier: regularised quadratic discriminant over document statistics.

One pass turns every whole text into a few transformed statistics.  The class means and
covariances are sums over all labelled rows outside the held-out fold, made by Spark's own
aggregates.  Each class covariance is shrunk towards the pooled one and towards a multiple of
the identity; its Cholesky factor is computed once and sent with the tasks.  A document's score
is the logistic of the difference of the classes' log densities, from Mahalanobis distances by
triangular solves, plus that of the log priors.

Inputs of a score are the text's statistics alone, never labels, language, source or id.

Defined results: null and empty texts have the statistics of an empty text and a score as any
other; a training set with one class gives that class's label as the score everywhere, and an
empty one 0.5; label rows without a document or a quality are left out, repeated ones count as
often as they stand; repeated documents are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import by_position, crc_mod, map_rows, SLICE, stored

THRESHOLD = 0.3
#: Weights of the pooled covariance and of the scaled identity in each class covariance.
TO_POOLED = 0.3
TO_IDENTITY = 0.05

FEATURES = ("log_words", "word_length", "symbols", "pipes", "bangs", "upper", "digits", "stops", "repeats", "variety", "dup_lines", "line_words")
_SYMBOLS, _DIGITS, _STOPS = np.frombuffer(b"#*$%&<>", np.uint8), np.frombuffer(b"0123456789", np.uint8), np.frombuffer(b".,;:?", np.uint8)


def statistics(text: str) -> list[float]:
    """``FEATURES`` of one text.  Shares are damped so that single occurrences weigh little."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, int(counts.sum()))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    share = lambda k, of: math.log((k + 0.5) / (of + 25.0) + 0.01)
    same = sum(map(eq, words, words[1:]))
    few = len(set(words))
    return [
        math.log1p(n), math.log1p(sum(map(len, words)) / n if n else 0.0), share(int(counts[_SYMBOLS].sum()), n), share(int(counts[124]), n), share(int(counts[33]), n),
        upper / (upper + lower + 60.0), share(int(counts[_DIGITS].sum()), chars + 300), share(int(counts[_STOPS].sum()), n), share(same, n),
        math.log((few + 5.0) / (n**0.85 + 5.0)), (len(lines) - len(set(lines))) / (len(lines) + 3.0), math.log1p(n / max(1, len(lines))),
    ]


_TABLE = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``FEATURES`` of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            got = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            return {"doc_id": batch.column(0)} | {f: got[:, i] for i, f in enumerate(FEATURES)}

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), _TABLE, make)


@dataclass(frozen=True)
class Model:
    """For each class its mean, Cholesky factor and half log determinant; None for a constant score."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def model_of(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Model:
    """From counts, sums and sums of products of classes 0 and 1."""
    if n.sum() == 0:
        return Model(None, None, None)
    if n.min() == 0:
        return Model(None, None, None, float(n[1] > 0))
    means = sums / n[:, None]
    covs = products / n[:, None, None] - np.einsum("ci,cj->cij", means, means)
    pooled = np.einsum("c,cij->ij", n, covs) / n.sum()
    d, factors, offsets = means.shape[1], [], []
    scale = np.sqrt(np.diag(pooled)) + 1e-3
    for c in range(2):
        cov = (1 - to_pooled) * covs[c] + to_pooled * pooled
        unit = cov / np.outer(scale, scale)  # shrunk in the statistics' own units
        unit = (1 - to_identity) * unit + to_identity * max(np.trace(unit) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(unit * np.outer(scale, scale))
        factors.append(factor)
        offsets.append(math.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Model(means, np.array(factors), np.array(offsets))


def fit(table: DataFrame, labels: DataFrame, train) -> Model:
    """Moments of all rows of ``table`` with a label where ``train`` (a condition on doc_id) holds."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality")).where(F.col("quality").isin(0, 1))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        table.where(train).join(marks, "doc_id").groupBy("quality")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    )
    n, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = r["quality"]
        n[c], sums[c] = r["n"], [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = r[f"p{i}_{j}"]
    return model_of(n, sums, products)


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scored(table: DataFrame, model: Model) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
            return {"doc_id": batch.column(0), "score": model.score(x)}

        return work

    return map_rows(table.select("doc_id", *FEATURES), _SCORED, make)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fold 0 of ``folds`` is held out."""
    table = stored(spark, features(docs), "quality")
    model = fit(table, labels, crc_mod(F.col("doc_id"), folds) != 0)
    return scored(table, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def filtered(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted as good, with their columns; a second pass over the texts, and no shuffle of them."""
    return by_position(docs, ("doc_id", "text"), lambda named: _filtered(spark, named, labels, folds, threshold))


def _filtered(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int, threshold: float) -> DataFrame:
    model = fit(stored(spark, features(docs), "quality"), labels, crc_mod(F.col("doc_id"), folds) != 0)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                got = model.score(np.array([statistics(t or "") for t in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(got >= threshold))

    return docs.mapInArrow(run, schema)
