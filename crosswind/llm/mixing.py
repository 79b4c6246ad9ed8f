"""Mixing sources to target weights by iterative proportional fitting.

Documents are cells of source, language and topic.  The table of the cells' tokens is raked: in
turn for each dimension, every cell's weight is scaled so that the dimension's marginal meets its
target, until all do.  Weights are bounded so that half of the tokens stay, but for given targets that need more; a
given target that can't be met, because cells have no tokens, is an error, and a tempered one that isn't met gives a
warning that says by how much.  A cell's factor over the largest one is the probability with which its
documents stay; a hash of id and text decides, so that a run is repeatable.  Probabilities are calibrated: expected kept tokens of a cell are its raked weight.

Targets are shares by value; values that a target does not name share what is left by their own
tokens, and values without tokens give their share to the others.  Without given targets a
marginal is tempered: shares to the power ``TEMPER``, made to sum to one.

The topic of a document is the nearest of ``TOPICS`` directions to its hashed words: directions
come from rounds of spherical k-means over all rows, started from a sample, each document is assigned
from its whole text.  The cells of all values are raked.

Defined results: null text has no tokens and its topic is -1; null values are values of their
own; documents without tokens stay, and so do all of the cell with the largest factor; repeated
rows are decided alike; texts of any length count whole; ties between topics go to the first; an empty table gives
an empty result; the result has the input's columns, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import by_position, discard, map_rows, only_table, SLICE, stored

TOPICS = 8
DIMENSIONS = 256
#: Rows that the starting points of topics come from, rounds of k-means over all rows, and the whole number that stands for one.
FIT_ROWS = 4000
FIT_ROUNDS = 12
UNIT = (1 << 15) - 1
SEED = 11
TEMPER = 0.85
#: The error beyond which a target is missed, and the part of the tokens that tempered shares leave at least.
MISSED = 1e-6
LEAST_KEPT = 0.5
RAKE_ROUNDS = 500
RAKE_WITHIN = 1e-9
WORD_ENTRIES = 200_000
NONE = "\x00none"


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 3) % DIMENSIONS
        return value


_SLOTS = _Slots()
DIMENSION_NAMES = ("source", "lang", "topic")


def direction(text: str) -> tuple[np.ndarray, int]:
    """Unit vector of the damped counts of hashed lower-cased words, and the number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    v = np.log1p(np.bincount([_SLOTS[w] for w in words], minlength=DIMENSIONS)) if words else np.zeros(DIMENSIONS)
    size = np.sqrt(v @ v)
    return (v / size if size else v), len(words)


def whole(v: np.ndarray) -> np.ndarray:
    """A direction in whole numbers, so that sums don't depend on their order."""
    return np.rint(v * UNIT).astype(np.int16)


def topic_of(centre: np.ndarray, v: np.ndarray, n: int) -> int:
    """The nearest of the topics to a direction in whole numbers; -1 without words."""
    return int((centre @ v).argmax()) if n and len(centre) else -1


_VECTOR = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("tokens", T.LongType()), T.StructField("v", T.BinaryType()),
])


def vectors_of(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of id and text, source, lang, tokens (words) and direction of every document."""

    def make():
        only_table(_SLOTS)

        def work(batch: pa.RecordBatch) -> dict:
            got = [direction(t) for t in batch.column(4).to_pylist()]
            return {"doc_id": batch.column(0), "key": batch.column(1), "source": batch.column(2), "lang": batch.column(3), "tokens": [n for _, n in got], "v": [whole(v).tobytes() for v, _ in got]}

        return work

    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), named("source"), named("lang"), F.coalesce("text", F.lit("")).alias("text")), _VECTOR, make)


def fit_topics(table: DataFrame, topics: int = TOPICS, rows: int = FIT_ROWS) -> np.ndarray:
    """Topic directions of all rows of ``vectors_of``; those with the ``rows`` smallest hashes give the starting points."""
    vectors = table.where("tokens > 0").select("key", "v")
    few, part = vectors, min(1.0, 2 * rows / max(1, vectors.count()))  # thinned by the hash first, so that little is sorted
    if part < 1:
        few = few.where(F.pmod("key", F.lit(1 << 20)) < int(part * (1 << 20)))
    got = few.orderBy("key").limit(rows).toPandas().drop_duplicates("key")
    x = np.array([np.frombuffer(v, np.int16) for v in got["v"]], float).reshape(-1, DIMENSIONS) / UNIT
    rng = np.random.default_rng(SEED)
    if not len(x):
        return np.zeros((0, DIMENSIONS))
    centre = x[[int(rng.integers(len(x)))]]
    while len(centre) < min(topics, len(x)):  # far from those that there are
        far = np.clip(1 - (x @ centre.T).max(axis=1), 0, None) ** 2
        if not far.sum() > 1e-12:
            break
        centre = np.vstack([centre, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(FIT_ROUNDS):
        sums = _sums(vectors, centre)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 0, sums / np.where(size > 0, size, 1), centre)
        if np.array_equal(new, centre):
            break
        centre = new
    return centre


def _sums(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """For each direction the sum of all vectors nearest to it; sums of integers, so in any order."""

    def run(batches):
        sums = np.zeros(centre.shape, np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(-1, DIMENSIONS)
            own = (x @ centre.T).argmax(axis=1)
            for k in np.unique(own):
                sums[k] += x[own == k].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    got = vectors.select("v").mapInArrow(run, "sums binary")
    return sum((np.frombuffer(r["sums"], np.int64).reshape(centre.shape) for r in got.toLocalIterator()), np.zeros(centre.shape, np.int64))


_TOLD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("topic", T.IntegerType()), T.StructField("tokens", T.LongType())])


def told(table: DataFrame, centre: np.ndarray) -> DataFrame:
    """Rows of ``vectors_of`` with their topic in place of the direction."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            topic = [topic_of(centre, np.frombuffer(v, np.int16), n) for v, n in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist())]
            return {"doc_id": batch.column(0), "key": batch.column(1), "source": batch.column(2), "lang": batch.column(3), "topic": topic, "tokens": batch.column(4)}

        return work

    return map_rows(table.select(*_VECTOR.fieldNames()), _TOLD, make)


def goals(names: list, mass: np.ndarray, target: dict | None, temper: float = TEMPER) -> np.ndarray:
    """Target shares of the values of a dimension."""
    share = mass / mass.sum()
    if target is None:
        out = np.where(share > 0, share**temper, 0.0)
    else:
        given = np.array([float(target.get(n, 0.0)) for n in names])
        free = np.array([n not in target for n in names])
        left = max(0.0, 1.0 - sum(float(v) for v in target.values()))
        out = given + (left * np.where(free, share, 0) / share[free].sum() if free.any() and share[free].sum() > 0 else 0.0)
    return out / out.sum()


def rake_cells(at: list[np.ndarray], share: np.ndarray, wanted: list[np.ndarray], rounds: int = RAKE_ROUNDS, within: float = RAKE_WITHIN, most: float = np.inf) -> tuple[np.ndarray, list[float]]:
    """Weights of the cells whose marginals meet ``wanted``, and the largest error left in each dimension.

    A cell has its values' places in ``at`` and its share; no weight is over ``most`` times that.
    """
    out, errors = share, [np.inf] * len(wanted)
    for _ in range(rounds):
        for place, goal in zip(at, wanted):
            now = np.bincount(place, weights=out, minlength=len(goal))
            out = np.minimum(out * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[place], most * share)
        errors = [float(np.abs(np.bincount(place, weights=out, minlength=len(goal)) - goal).max()) for place, goal in zip(at, wanted)]
        if max(errors) < within:
            break
    return out, errors


def rake(mass: np.ndarray, wanted: list[np.ndarray], rounds: int = RAKE_ROUNDS, within: float = RAKE_WITHIN) -> tuple[np.ndarray, float]:
    """``rake_cells`` of a whole array of cells, with the largest error of all dimensions."""
    out, errors = rake_cells([i.ravel() for i in np.indices(mass.shape)], mass.ravel() / mass.sum(), wanted, rounds, within)
    return out.reshape(mass.shape), max(errors)


def probabilities(cells: list[tuple], targets: dict[str, dict] | None = None, rate: float | None = None, temper: float = TEMPER) -> dict[tuple, float]:
    """The chance to stay of each cell of (source, lang, topic, tokens): its factor over the largest.

    The rate of kept tokens is the highest at which all chances are calibrated, unless a lower
    one is given.  Weights are first bounded so that ``LEAST_KEPT`` of the tokens stay; given targets
    that can't be met so are met without the bound, at a lower rate.
    """
    cells = [c for c in cells if c[3] > 0]
    if not cells:
        return {}
    names = [sorted({c[d] for c in cells}, key=str) for d in range(3)]
    place = [{n: i for i, n in enumerate(ns)} for ns in names]
    at = [np.array([place[d][c[d]] for c in cells]) for d in range(3)]
    mass = np.array([c[3] for c in cells], float)
    share = mass / mass.sum()
    wanted = [goals(names[d], np.bincount(at[d], weights=mass), (targets or {}).get(DIMENSION_NAMES[d]), temper) for d in range(3)]
    given = {d for d in range(3) if DIMENSION_NAMES[d] in (targets or {})}
    order = sorted(range(3), key=lambda d: d in given)  # given targets are met last
    raked = lambda most: rake_cells([at[d] for d in order], share, [wanted[d] for d in order], most=most)
    weights, errors = raked(1 / LEAST_KEPT)
    if any(e > MISSED for d, e in zip(order, errors) if d in given):
        weights, errors = raked(np.inf)
    for d, error in zip(order, errors):
        if error > MISSED:
            said = f"the shares of {DIMENSION_NAMES[d]} miss their targets by up to {error:.3g}"
            if d in given:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
    factor = weights / share
    chance = factor / factor.max()
    if rate is not None:
        chance = chance * min(1.0, rate / float(chance @ share))
    return {tuple(c[:3]): float(x) for c, x in zip(cells, chance)}


def misses(cells: list[tuple], chance: dict[tuple, float], targets: dict[str, dict] | None = None, temper: float = TEMPER) -> list[dict]:
    """For each dimension by how much the expected share of each value is over its target."""
    cells, out = [c for c in cells if c[3] > 0], []
    kept = np.array([c[3] * chance[tuple(c[:3])] for c in cells], float)
    for d, name in enumerate(DIMENSION_NAMES):
        values = sorted({c[d] for c in cells}, key=str)
        at = np.array([values.index(c[d]) for c in cells], int)
        wanted = goals(values, np.bincount(at, weights=[c[3] for c in cells]), (targets or {}).get(name), temper) if values else []
        reached = np.bincount(at, weights=kept, minlength=len(values)) / kept.sum() if values else []
        out.append({v: float(r - w) for v, r, w in zip(values, reached, wanted)})
    return out


@dataclass(frozen=True)
class Mix:
    """Fitted topics, the chance of each cell, and by how much each value's share misses its target."""

    centre: np.ndarray
    chance: dict[tuple, float]
    missed: list[dict]

    def of(self, source: str | None, lang: str | None, topic: int) -> float:
        """A cell that no document had when the mix was fitted, as after other rounding of a topic elsewhere, stays."""
        return self.chance.get((NONE if source is None else source, NONE if lang is None else lang, topic), 1.0)


def fit(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None = None, rate: float | None = None, start_rows: int = FIT_ROWS) -> tuple[Mix, DataFrame]:
    """The mix for ``docs`` and the table of what its documents are (see ``told``)."""
    vectors = stored(spark, vectors_of(docs), "vectors")
    centre = fit_topics(vectors, rows=start_rows)
    table = stored(spark, told(vectors, centre), "told")
    discard(spark, vectors)
    rows = table.groupBy(*DIMENSION_NAMES).agg(F.sum("tokens").alias("tokens")).collect()
    cells = [tuple(r) for r in rows]
    chance = probabilities(cells, targets, rate)
    return Mix(centre, chance, misses(cells, chance, targets)), table


def _draw(key: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    return ((key & ((1 << 30) - 1)) + 0.5) / (1 << 30)


_DECIDED = T.StructType([*_TOLD.fields[:1], *_TOLD.fields[2:], T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType()), *[T.StructField(f"{n}_miss", T.DoubleType()) for n in DIMENSION_NAMES]])


def decide(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None = None, rate: float | None = None, start_rows: int = FIT_ROWS) -> DataFrame:
    """One row a document: doc_id, source, lang, topic, tokens, probability and kept, and for its source, lang and topic by how much their expected share is over its target.

    Tempered shares are missed by what the bound on weights leaves; given ones are met, or an error.
    """
    mix, table = fit(spark, docs, targets, rate, start_rows)
    given = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            source, lang, topic, tokens = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            chance = [mix.of(s, g, t) if n else 1.0 for s, g, t, n in zip(source, lang, topic, tokens)]
            kept = _draw(batch.column(1).to_numpy()) < np.array(chance)
            return {"doc_id": batch.column(0), "source": source, "lang": lang, "topic": topic, "tokens": tokens, "probability": chance, "kept": kept} | {
                f"{n}_miss": [found.get(NONE if v is None else v) for v in values] for n, found, values in zip(DIMENSION_NAMES, mix.missed, (source, lang, topic))
            }

        return work

    return map_rows(table.select("doc_id", "key", given("source"), given("lang"), "topic", "tokens"), _DECIDED, make)


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None = None, rate: float | None = None, start_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that stay, with the input's columns.

    A second pass over the texts decides as ``decide`` does; so no text is shuffled.
    """
    return by_position(docs, ("doc_id", "text", "source", "lang"), lambda named: _sample(spark, named, targets, rate, start_rows))


def _sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None, rate: float | None, start_rows: int) -> DataFrame:
    mix, _ = fit(spark, docs, targets, rate, start_rows)
    names = docs.columns
    at = {c: i for i, c in enumerate(names)}
    fresh = "_" * (1 + max(map(len, names))) + "key"  # no column's name
    keyed = docs.withColumn(fresh, F.xxhash64("doc_id", "text"))

    def run(batches):
        only_table(_SLOTS)
        for rows in batches:
            for start in range(0, rows.num_rows, SLICE):
                batch, keep = rows.slice(start, SLICE), []
                for text, source, lang, u in zip(batch.column(at["text"]).to_pylist(), batch.column(at["source"]).to_pylist(), batch.column(at["lang"]).to_pylist(), _draw(batch.column(len(at)).to_numpy())):
                    v, n = direction(text or "")
                    keep.append(not n or u < mix.of(source, lang, topic_of(mix.centre, whole(v), n)))
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array(keep))

    return keyed.mapInArrow(run, docs.schema)
