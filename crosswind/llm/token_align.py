"""Alignment of two tokenizers' tokens by the bytes they cover.

A is a byte-level vocabulary over space + text, B a piece model over text, which adds that space.  In
each batch of documents, ``merge_asof`` keyed by document gives for every token start the other side's
token that covers it; the union of both directions is all overlaps, and overlaps with equal ends cut the
text into groups.  Links are all pairs of an A and a B token of one group.  How many documents hold an id
pair linked is counted over the whole corpus from one row for each pair and block of documents, and the
counts go back to the blocks, not to every document: a pair that a third of all documents hold is one row
of each block.

Defined results: texts that are null or empty, or that either tokenizer does not give back exactly, have no
tokens and get zeros and an empty digest; strings of special tokens are ordinary text; texts of any length
are encoded whole; repeated ids, null ids and repeated texts are documents of their own; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm import _tokens
from crosswind.llm._shared import stored, texts

#: Documents of a block, and their pairs after which a block ends sooner.
BLOCK_DOCS, BLOCK_PAIRS = 4096, 2_000_000
#: Characters that are aligned at once, unless a single text has more.
BATCH_CHARS = 500_000
#: Links made at once; groups that would make more than ``WIDE`` are reduced to distinct ids with counts first.
CHUNK_LINKS, WIDE = 1_000_000, 4096

_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
#: Rows of documents, and in the last two columns one row for each block: its pairs, and how many of its documents hold them.
ALIGNED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType()), *_FIELDS, T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType())),
    T.StructField("block_pairs", T.ArrayType(T.LongType())), T.StructField("block_docs", T.ArrayType(T.LongType())),
])
COUNTED = T.StructType([
    T.StructField("doc_id", T.LongType()), *_FIELDS, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("groups_sha256", T.StringType()),
])


class Side:
    """One side's tokens of a batch: ids, document numbers, and byte ranges counted over the batch."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray):
        self.ids = np.concatenate(ids) if ids else np.empty(0, "i4")
        self.n = np.array([len(x) for x in ids], "i8")
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.end = np.cumsum(lengths[self.ids])
        self.start = self.end - lengths[self.ids]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "at": self.start, "token": np.arange(len(self.ids))}, copy=False)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens that share a byte; a pair whose tokens begin together appears twice."""
    fa, fb = a.frame(), b.frame()
    covered, covering = (pd.merge_asof(x, y, on="at", by="doc", suffixes=("", "_other")) for x, y in ((fa, fb), (fb, fa)))
    return (np.concatenate([covered["token"].to_numpy(), covering["token_other"].to_numpy("i8")]), np.concatenate([covered["token_other"].to_numpy("i8"), covering["token"].to_numpy()]))


def grouped(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The group, counted over the batch, of every A and of every B token."""
    i, j = overlaps(a, b)
    same = a.end[i] == b.end[j]
    ends_a, ends_b = np.zeros(len(a.ids), "i8"), np.zeros(len(b.ids), "i8")
    ends_a[i[same]], ends_b[j[same]] = 1, 1
    return np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "i8")
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _narrow(group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, ids and counts; ids are distinct in the groups marked wide."""
    times = np.ones(len(ids), "i8")
    if not wide.any():
        return group, ids.astype("i8"), times
    deep = wide[group]
    keys, many = _summed(group[deep].astype("i8") << 32 | ids[deep], times[deep])
    group, ids, times = np.concatenate([group[~deep], keys >> 32]), np.concatenate([ids[~deep], keys & 0xFFFFFFFF]).astype("i8"), np.concatenate([times[~deep], many])
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], times[order]


def links(a: Side, b: Side, ga: np.ndarray, gb: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, id pairs (A's above 32 bits) and numbers of links, by document and pair."""
    doc_of = np.zeros(n_groups, "i8")
    doc_of[ga] = a.doc
    wide = np.bincount(ga, minlength=n_groups) * np.bincount(gb, minlength=n_groups) > WIDE
    (ga, ia, ta), (gb, ib, tb) = _narrow(ga, a.ids, wide), _narrow(gb, b.ids, wide)
    n_b = np.bincount(gb, minlength=n_groups)
    first_b, reach = np.cumsum(n_b) - n_b, n_b[ga]
    total = np.cumsum(reach)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(ga):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK_LINKS, "right")))
        r = reach[lo:hi]
        at_a = np.repeat(np.arange(lo, hi), r)
        at_b = np.arange(len(at_a)) - np.repeat(np.cumsum(r) - r, r) + np.repeat(first_b[ga[lo:hi]], r)
        kept.append(_by_document(doc_of[ga[at_a]], ia[at_a] << 32 | ib[at_b], ta[at_a] * tb[at_b]))
        lo = hi
    if len(kept) == 1:
        return kept[0]
    return _by_document(*(np.concatenate(x) for x in zip(*kept, strict=True))) if kept else (doc_of[:0], doc_of[:0], doc_of[:0])


def _by_document(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]))
    return doc[first], pair[first], np.add.reduceat(times, first)


class Aligner:
    """Both tokenizers of a worker, with the tables that batches look up."""

    def __init__(self, a: _tokens.ByteBpe, b: _tokens.Pieces):
        self.a, self.b = a, b
        self.len_a, self.len_b = (np.zeros(max(x.bytes_of) + 1, "i8") for x in (a, b))
        for lengths, x in ((self.len_a, a), (self.len_b, b)):
            for i, piece in x.bytes_of.items():
                lengths[i] = len(piece)
        #: An id's text with what follows it: A's ids before "," and "|", then B's before "," and ";".
        self.said = [b"%d%s" % (i, s) for n, seps in ((len(self.len_a), b",|"), (len(self.len_b), b",;")) for s in (seps[:1], seps[1:]) for i in range(n)]

    def tokens(self, texts: list[str]) -> tuple[Side, Side]:
        ids_a, ids_b, none = [], [], np.empty(0, "i4")
        for text, b in zip(texts, self.b.encode(texts), strict=True):
            whole, a = (" " + text).encode(), none
            if text and b"".join(map(self.b.bytes_of.__getitem__, b)) == whole:
                a = self.a.encode(" " + text)
                if b"".join(map(self.a.bytes_of.__getitem__, a.tolist())) != whole:
                    a = none
            ids_a.append(a)
            ids_b.append(np.array(b, "i4") if len(a) else none)
        return Side(ids_a, self.len_a), Side(ids_b, self.len_b)

    def said_groups(self, a: Side, b: Side, ga: np.ndarray, gb: np.ndarray, n_groups: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every document, by places of the tokens in one sequence."""
        n_a, n_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        code_a, code_b = a.ids.astype("i8"), b.ids.astype("i8") + 2 * len(self.len_a)
        code_a[last_a] += len(self.len_a)
        code_b[last_b] += len(self.len_b)
        both = np.empty(len(code_a) + len(code_b), "i8")
        both[np.arange(len(code_a)) + before_b[ga]] = code_a
        both[np.arange(len(code_b)) + before_a[gb]] = code_b
        out, at, words = [], 0, list(map(self.said.__getitem__, both.tolist()))
        for n in (a.n + b.n).tolist():
            out.append(b"".join(words[at : at + n])[:-1])
            at += n
        return out

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
        """Columns of the documents, and documents, pairs and times of their links."""
        a, b = self.tokens(texts)
        ga, gb = grouped(a, b)
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        doc_of = np.zeros(n_groups, "i8")
        doc_of[ga] = a.doc
        doc, pair, times = links(a, b, ga, gb, n_groups)
        said = self.said_groups(a, b, ga, gb, n_groups)
        of_doc = np.zeros(len(texts), "i8")
        np.add.at(of_doc, doc, times)
        columns = {"n_a": a.n, "n_b": b.n, "n_groups": np.bincount(doc_of, minlength=len(texts)), "n_links": of_doc, "groups_sha256": [hashlib.sha256(s).hexdigest() if s else "" for s in said]}
        return columns, doc, pair, times


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BATCH_CHARS:
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def aligned(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``ALIGNED``: what each document's alignment gives by itself, and the pairs of each block of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, into = Aligner(_tokens.byte_bpe(byte_path), _tokens.pieces(piece_path)), to_arrow_schema(ALIGNED)
        block, n_docs, n_pairs, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def closed() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows(into, 1, block=[block], block_pairs=[pairs], block_docs=[n])

        for batch in batches:
            ids, every = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in _slices(every):
                if n_docs >= BLOCK_DOCS or n_pairs >= BLOCK_PAIRS:
                    yield closed()
                    block, n_docs, n_pairs, held = block + 1, 0, 0, []
                columns, doc, pair, times = aligner.align(every[lo:hi])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=hi - lo))]), pa.int32())
                yield _rows(into, hi - lo, block=np.full(hi - lo, block), doc_id=ids.slice(lo, hi - lo), **columns, pairs=pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())), times=pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())))
                n_docs, n_pairs = n_docs + hi - lo, n_pairs + len(pair)
                held.append(pair)
        if held:
            yield closed()

    return texts(docs, "doc_id", "text").mapInArrow(run, ALIGNED)


def _rows(into: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in into], schema=into)


def pair_counts(table: DataFrame) -> DataFrame:
    """For every block and pair of it: the pair's documents over the corpus, and whether no pair of its A id has more."""
    held = table.where(F.col("block_pairs").isNotNull()).select(F.col("block").alias("of_block"), F.explode(F.arrays_zip("block_pairs", "block_docs")).alias("p")).select("of_block", F.col("p.block_pairs").alias("pair"), F.col("p.block_docs").alias("docs"))
    totals = held.groupBy("pair").agg(F.sum("docs").alias("count"))
    totals = totals.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("pair", 32))))
    return held.select("of_block", "pair").join(totals, "pair")


def counted(table: DataFrame) -> DataFrame:
    """``COUNTED``: each block's documents beside the counts of its pairs."""

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        left, right = left.combine_chunks(), right.combine_chunks()
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        count, best, pair = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order], pair[order]
        lists = left.column("pairs").combine_chunks()
        n = lists.value_lengths().to_numpy().astype("i8")
        times, at = left.column("times").combine_chunks().flatten().to_numpy(), np.searchsorted(pair, lists.flatten().to_numpy())
        ends = np.cumsum(n)

        def by_document(values: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(values)])
            return run[ends] - run[ends - n]

        given = {"n_best": by_document(times * best[at]), "count_sum": by_document(times * count[at])}
        into = to_arrow_schema(COUNTED)
        return pa.table([pa.array(given[f.name]) if f.name in given else left.column(f.name) for f in into], schema=into)

    docs = table.where(F.col("pairs").isNotNull()).select("block", "pairs", "times", *(f.name for f in COUNTED if f.name not in ("n_best", "count_sum")))
    return docs.groupBy("block").cogroup(pair_counts(table).groupBy("of_block")).applyInArrow(sums, COUNTED)


def align(spark: SparkSession, docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Groups and links of every document with corpus-wide counts of its id pairs.  Paths are ones that executors have too."""
    return counted(stored(spark, aligned(docs, byte_path, piece_path), "aligned"))
