"""Best-fit packing with certified bin counts.

Documents become token ids, ids longer than a sequence are cut, and the pieces are packed by
best-fit decreasing inside hash partitions.  Dual-feasible functions give each partition a
lower bound on its bins: a partition that meets its bound is certified.  What an uncertified
partition has in bins with room, and the emptiest bin of each certified one, is exchanged over
fewer partitions and packed again.  Rounds end when one partition has been packed or a round has
spared no bin, and no task ever holds more than about ``FAN_IN`` times ``per_partition`` pieces.

Defined results: null text is the empty text; a text without tokens is the single end id; special
tokens inside a text are what the plain tokenizer call makes of them; a text of any length is cut
whole; ties in length go by document id, piece and row; repeated ids are packed as separate rows; a null id is packed like
any other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import map_rows, only_table, stored, texts

CAPACITY = 2048
END_ID = 0
#: Pieces in a partition of the first round, how many times as many one of a later round may hold and how many meet in one.
PER_PARTITION = 60_000
FAN_IN = 8
#: Rounds that a sequence's number has room for; as each round spares a bin or is the last, and meets in fewer partitions, far fewer happen.
MOST_ROUNDS = 120
#: Entries of a worker's table from word pieces to ids; it starts anew beyond that.
CACHE_ENTRIES = 500_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("row", T.LongType()),
])
PLACED = T.StructType([
    *PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("moves", T.BooleanType()),
])

#: Outside this the lower case of a text is left to the tokenizer: its rules may look at neighbours.
_PLAIN = re.compile("[^\x00-\x1b\x20-\xff]")
#: The tokenizer's own split of lower-cased Latin-1 text; its parts are encoded independently.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\s0-9²³¹¼-¾a-zªµºß-öø-ÿ]+")
_KEPT: dict[str, tuple] = {}


class Encoder:
    """Little-endian unsigned 32-bit ids of a text, with a bounded table of the parts seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with one of the vocabulary's special tokens are encoded whole: the tokenizer cuts those out first.
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.seen: dict[str, bytes] = {}

    def raw(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if _PLAIN.search(text) or self.special.search(text):
            return self.raw(text)
        seen, parts = self.seen, _PARTS.findall(text.lower())
        try:
            return b"".join([seen[p] for p in parts])
        except KeyError:
            pass
        if len(seen) > CACHE_ENTRIES:
            seen.clear()
        out = []
        for p in parts:
            ids = seen.get(p)
            if ids is None:
                ids = self.raw(p)
                if len(p) <= 40:
                    seen[p] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def cut(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: ``PIECES``. ``vocabulary`` is a path that executors have too.

    ``row`` numbers the pieces; a task that runs again numbers them as before.
    """

    def make():
        import public_tokenizers
        from pyspark import TaskContext

        encode = encoder(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        only_table(encode.seen)
        end = struct.pack("<I", END_ID)
        rows = itertools.count(TaskContext.get().partitionId() << 33)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["row"].append(next(rows))
            return out

        return work

    return map_rows(texts(docs, "doc_id", "text"), PIECES, make)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the dual-feasible functions of two families."""
    if not len(lengths):
        return 0
    size, count = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    best = -(-int((size * count).sum()) // capacity)
    # at threshold t: over capacity - t a whole bin, under t nothing, between them itself
    for t in np.unique(np.minimum(size, capacity - size))[:]:
        if 0 < t <= capacity // 2:
            value = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
            best = max(best, -(-int((value * count).sum()) // capacity))
    # in k + 1 parts: a whole number of parts counts as itself, else the parts below, over k
    for k in range(1, 33):
        parts = (k + 1) * size
        whole = parts % capacity == 0
        value = np.where(whole, parts * k, parts // capacity * capacity * (k + 1))
        best = max(best, -(-int((value * count).sum()) // (capacity * k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item of lengths sorted from the largest, and the number of bins.

    A bit for each free capacity that some bin has finds the tightest bin in one step.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, length in enumerate(lengths.tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def place(pieces: DataFrame, parts: int, round_no: int, last: bool, capacity: int = CAPACITY) -> DataFrame:
    """Packs each of ``parts`` hash partitions; ``moves`` marks the pieces to exchange.

    Rows are sorted first, so that a task that runs again numbers its bins as before.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in PIECES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        col = lambda n: table.column(n).fill_null(-1).to_numpy()
        table = table.take(pa.array(np.lexsort((col("row"), col("piece"), col("doc_id"), -col("length")))))
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=n)
        roomy = filled < capacity
        if last:
            leaves = np.zeros(n, bool)
        elif n == lower_bound(lengths, capacity):  # certified: at most the emptiest bin can go
            leaves = np.zeros(n, bool)
            leaves[int(np.argmin(filled))] = True
            leaves &= roomy
        else:
            leaves = roomy
        base = (round_no << 56) | (TaskContext.get().partitionId() << 32)
        yield pa.RecordBatch.from_arrays(
            [table.column(n).combine_chunks() for n in names] + [pa.array(bins + base), pa.array(offsets), pa.array(leaves[bins])], schema=to_arrow_schema(PLACED)
        )

    dealt = pieces.select(*names).repartition(parts, F.xxhash64(F.lit(round_no), "row"))
    return dealt.mapInArrow(run, PLACED)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Every piece with its sequence and its place there. See the module for the method."""
    waiting = stored(spark, cut(docs, vocabulary, capacity), "pieces")
    parts, done, round_no, before = max(1, -(-waiting.count() // per_partition)), [], 0, None
    while True:
        last = parts == 1 or round_no == MOST_ROUNDS
        placed = stored(spark, place(waiting, parts, round_no, last, capacity), "placed")
        bins = placed.groupBy("moves").agg(F.count(F.lit(1)).alias("pieces"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).collect()
        moving = {r["moves"]: r for r in bins}.get(True)
        spared = None if before is None else before - sum(r["bins"] for r in bins)
        if last or moving is None or spared is not None and spared <= 0:
            done.append(placed)
            break
        done.append(placed.where(~F.col("moves")))
        waiting, before = placed.where("moves"), moving["bins"]
        parts, round_no = max(-(-moving["pieces"] // (FAN_IN * per_partition)), -(-parts // FAN_IN)), round_no + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*[f.name for f in PIECES if f.name != "row"], "sequence_id", "offset")
