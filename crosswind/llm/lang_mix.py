"""Language identification by mixtures of languages.

A model holds each learned language's probabilities of hashed byte trigrams of lower-cased
letters and blanks.  A document's trigrams are taken as drawn from a mixture of the languages:
expectation-maximisation estimates its proportions over the whole text, and languages join the
set one by one as long as the penalised likelihood grows.  The answer is the language with the
largest part.

Inputs of a prediction are the text's alone; ids, sources and labels are not.

Defined results: null texts and texts without a letter are ``und`` with score 0, and all are
where nothing could be learned; ties go to the first language by name; a text of letters that
no language has goes by the languages' shares; rows with a null language teach nothing;
repeated rows are judged each, texts of any length whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import crc_mod, map_rows

CELLS = 1 << 16
#: About so many labelled rows, taken by a hash of the id, teach the model.
TRAIN_ROWS = 20_000
#: Languages up to which the model is a dense table; of more, only the cells that a language has are kept, with equal values.
DENSE = 256
ROUNDS = 30
#: Trigrams overlap, so that one character bears on three; what a language must gain, in units of log n.
DEPENDENT = 3.0
PENALTY = 4.0
LEAST_PART = 0.03
SMOOTH = 0.2

_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(c if 0x61 <= c <= 0x7A or c > 0x7F else 0x20 for c in range(256))


def cells(text: str) -> np.ndarray:
    """Hashed trigrams in text order; none if there is no letter."""
    if not _LETTER.search(text):
        return np.zeros(0, np.int64)
    raw = b" ".join([b"", *text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split(), b""])
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class Sparse:
    """Rows of a table of CELLS x languages, of which only the cells that a language has are kept beside its value for all others."""

    def __init__(self, cell: np.ndarray, lang: np.ndarray, value: np.ndarray, rest: np.ndarray):
        order = np.argsort(cell, kind="stable")
        self.first = np.searchsorted(cell[order], np.arange(CELLS + 1))
        self.lang, self.value, self.rest = lang[order].astype("i4"), value[order].astype("f4"), rest.astype("f4")

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        out = np.tile(self.rest, (len(cells), 1))
        n = self.first[cells + 1] - self.first[cells]
        at = np.repeat(self.first[cells] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(cells)), n), self.lang[at]] = self.value[at]
        return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray | Sparse  # CELLS x languages
    shares: np.ndarray

    def mixture(self, grams: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The selected languages, largest part first, and their parts."""
        if len(grams) > 4096:
            count = np.bincount(grams, minlength=CELLS)
            seen = np.flatnonzero(count)
            count = count[seen].astype(float)
        else:
            seen, count = np.unique(grams, return_counts=True)
        logs = self.logs[seen]
        top = logs.max(axis=1, keepdims=True)
        prob, n = np.exp(logs - top), count.sum()
        single = count @ logs + np.log(self.shares)
        chosen = [int(np.argmax(single))]
        best, parts = float(count @ np.log(prob[:, chosen[0]])), np.ones(1)
        while len(chosen) < len(self.languages):
            found = None
            for lang in range(len(self.languages)):
                if lang in chosen:
                    continue
                p = prob[:, [*chosen, lang]]
                mine = np.append(parts * 0.8, 0.2)
                for _ in range(ROUNDS):
                    joint = p * mine
                    new = count @ (joint / joint.sum(axis=1, keepdims=True)) / n
                    done = np.abs(new - mine).max() < 1e-3
                    mine = new
                    if done or new[-1] < LEAST_PART / 2:
                        break
                value = float(count @ np.log(p @ mine + 1e-300))
                if mine[-1] >= LEAST_PART and (found is None or value > found[0]):
                    found = (value, lang, mine)
            if found is None or (found[0] - best) / DEPENDENT < PENALTY * np.log(n + 1.0) / 2 + 2.0:
                break
            best, parts = found[0], found[2]
            chosen.append(found[1])
        order = np.argsort(-parts, kind="stable")
        return [chosen[i] for i in order], parts[order]

    def judge(self, text: str) -> tuple[str, float]:
        """The language with the largest part, and that part; for a single language how sure it is beside the next."""
        grams = cells(text) if self.languages else np.zeros(0, np.int64)
        if not len(grams):
            return "und", 0.0
        chosen, parts = self.mixture(grams)
        if len(chosen) > 1:
            return self.languages[chosen[0]], float(parts[0])
        lead = np.sort(grams_total(self, grams))
        return self.languages[chosen[0]], float(1.0 / (1.0 + np.exp(np.clip(lead[-2] - lead[-1], -50, 0)))) if len(lead) > 1 else 1.0


def grams_total(model: Model, grams: np.ndarray) -> np.ndarray:
    return model.logs[grams].sum(axis=0) / DEPENDENT + np.log(model.shares)


_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
_JUDGED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From columns text and lang of about ``rows`` of ``docs``."""
    known = docs.where("lang is not null and text is not null")
    part = min(1.0, rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("lang", "text")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            by: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = cells(text)
                if len(grams):
                    np.add.at(by.setdefault(lang, np.zeros(CELLS + 1, np.int64)), grams, 1)
                    by[lang][CELLS] += 1
            out: dict[str, list] = {"lang": [], "cell": [], "n": []}
            for lang, count in by.items():
                at = np.flatnonzero(count)
                out["lang"] += [lang] * len(at)
                out["cell"] += at.tolist()
                out["n"] += count[at].tolist()
            return out

        return work

    # at most a row for each language and cell of the sample
    got = map_rows(sample, _COUNTS, make).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(got["lang"])))
    if not languages:
        return Model((), np.zeros((CELLS, 0)), np.zeros(0))
    cell, lang, n = got["cell"].to_numpy(), got["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(), got["n"].to_numpy(float)
    told = cell == CELLS  # documents, not trigrams
    docs_of = np.bincount(lang[told], n[told], len(languages))
    return Model(languages, logs_of(cell[~told], lang[~told], n[~told], len(languages)), docs_of / docs_of.sum())


def logs_of(cell: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int, dense: int = DENSE) -> np.ndarray | Sparse:
    """Logarithms of smoothed shares of cells by language."""
    total = np.bincount(lang, n, languages) + SMOOTH * CELLS
    value, rest = np.log((n + SMOOTH) / total[lang]), np.log(SMOOTH / total)
    if languages > dense:
        return Sparse(cell, lang, value, rest)
    out = np.tile(rest.astype(np.float32), (CELLS, 1))
    out[cell, lang] = value
    return out


def identify(spark: SparkSession, docs: DataFrame, folds: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; fold ``held`` of ``folds`` teaches nothing."""
    model = fit(docs.where(crc_mod(F.col("doc_id"), folds) != held), rows)
    sent = spark.sparkContext.broadcast(model)  # CELLS x languages of four bytes

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            got = [sent.value.judge(t) for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return work

    judged = map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), _JUDGED, make)
    return judged.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
