"""Near-duplicate detection: an inverted join over MinHash signature coordinates.

1. One pass over the texts makes each document's set of shingle hashes, its digest and its
   signature: a coordinate is the hash of ``WIDTH`` MinHash values, so that texts that only share
   common words collide in next to none.  Documents with equal sets are one class.
2. A class is posted under coordinate-value pairs.  Two classes that collide in ``MATCHES`` pairs
   share one of the first ``COORDINATES - MATCHES + 1`` of each, in any fixed order of pairs, so only
   those are posted (prefix), rarest first by a sketch of the pairs' counts; the frequent rest is
   skipped.  Posting lists of one class are dropped.
3. The member of a list whose lists are longest is its head, and all members of lists with one head
   are its group.  A group holds its members once, with their signatures and full sets.
4. Members are compared with their group's head: collisions are counted, and pairs above the match
   threshold are confirmed on the full sets.  Linked classes contract to components.
5. Where a group still has several components, its members outside the largest one are compared
   with all others in blocks, but for pairs linked already.  Only links between components become
   rows, so their number grows with members, not with pairs.
6. Components grow by hooking to the smallest neighbour and pointer jumping, in tables.

A pair at exactly the threshold of 0.8 collides in a coordinate with chance 0.41, and in less than ``MATCHES`` of
32 with chance 1.2e-5; a nearer one far less often.

Defined results: null text is the empty text; documents without words are alone; documents of
fewer words than a shingle have their whole sequence as one, texts of any length all of theirs;
repeated rows and equal sets are one class, of which the smallest id is kept; of different texts
under one id the one with the smallest set (ties by digest) stands for its links; a row without an id is
linked with nothing, has no component and is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import by_position, discard, map_rows, only_table, stored

#: Coordinates of a signature, MinHash values in each, and collisions from which a pair is a candidate.
COORDINATES = 32
WIDTH = 4
MATCHES = 3
SEED = 977
#: Counters of the sketch that orders coordinate-value pairs, and bits of the filter for reading texts
#: again; both of fixed size, and neither decides a result.
COUNTERS = 1 << 22
FILTER_BITS = 1 << 25
WORD_ENTRIES = 200_000
#: Members, and bytes of their sets, in one side of a block of a group.
BLOCK = 1024
BLOCK_BYTES = 16 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Hashes()


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; bytes.lower is A-Z only, and split is by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.array([_WORDS[w] for w in words], np.uint64)
    width = min(k, len(one))
    n = len(one) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ one[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64))


def _factors(coordinates: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, (coordinates * WIDTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each coordinate 32 bits of its MinHash values: the smallest products with a factor each, modulo 2^64."""
    least = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (factors * hashes[at : at + 4096]).min(axis=1), out=least)
    out = np.zeros(len(factors) // WIDTH, np.uint64)
    for value in (least >> np.uint64(32)).reshape(-1, WIDTH).T:
        out = (out ^ value) * _MIX
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("sig", T.BinaryType()),
])


def signatures(docs: DataFrame, k: int, coordinates: int = COORDINATES) -> DataFrame:
    """Set size, digest and signature of each row of (doc_id, text)."""

    def make():
        only_table(_WORDS)
        factors = _factors(coordinates)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"n": [], "hi": [], "lo": [], "sig": []}
            for text in batch.column(1).to_pylist():
                hashes = shingle_set(text, k)
                hi, lo = _digest(hashes)
                out["n"].append(len(hashes))
                out["hi"].append(hi)
                out["lo"].append(lo)
                out["sig"].append(signature(hashes, factors).tobytes() if len(hashes) else None)
            return {"doc_id": batch.column(0)} | out

        return work

    return map_rows(docs, _SETS, make)


def _pairs_of(sigs: np.ndarray) -> np.ndarray:
    """64-bit names of the coordinate-value pairs of rows of signatures."""
    mixed = (sigs.astype(np.uint64) << np.uint64(8)) + np.arange(sigs.shape[1], dtype=np.uint64) + np.uint64(1)
    mixed *= _MIX
    mixed ^= mixed >> np.uint64(31)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _rows_of(column: pa.Array, coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates)


_COUNTED = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType())])
_POSTED = T.StructType([T.StructField("token", T.LongType()), T.StructField("cls", T.LongType())])


def _sketch(classes: DataFrame, coordinates: int) -> np.ndarray:
    """Counts of frequent pairs by cell: a task tells those that stand out in it; COUNTERS rows at most reach the driver."""

    def run(batches):
        counts, total = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            if batch.num_rows:
                cells = (_pairs_of(_rows_of(batch.column(0), coordinates)) >> np.uint64(42)).astype(np.int64).ravel()
                counts += np.bincount(cells, minlength=COUNTERS)
                total += len(cells)
        at = np.flatnonzero(counts >= max(2.0, 1 + 6 * total / COUNTERS))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    # as columns: COUNTERS rows as Row objects take over 3 GB of the driver
    got = classes.select("sig").mapInArrow(run, _COUNTED).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.uint64)
    out[got["cell"].to_numpy()] = np.minimum(got["n"].to_numpy(), (1 << 19) - 1).astype(np.uint64)
    return out


def _postings(spark: SparkSession, classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, cls): each class under the first of its pairs by (count, name)."""
    sketch, prefix = spark.sparkContext.broadcast(_sketch(classes, coordinates)), coordinates - matches + 1

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            names = _pairs_of(_rows_of(batch.column(1), coordinates))
            order = (sketch.value[(names >> np.uint64(42)).astype(np.int64)] << np.uint64(44)) | (names & np.uint64((1 << 44) - 1))
            first = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
            return {"token": np.take_along_axis(names, first, axis=1).view(np.int64).ravel(), "cls": np.repeat(batch.column(0).to_numpy(), prefix)}

        return work

    return map_rows(classes.select("cls", "sig"), _POSTED, make)


def groups_of(spark: SparkSession, posts: DataFrame) -> DataFrame:
    """(head, cls), each once: every member of a list with the list's head, and the head with itself.

    Two classes of one list are both in its head's group.  The many lists of a group of like
    texts have few heads, so that a group stands for all of them.
    """
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    lists = stored(spark, posts.join(shared, "token"), "lists")
    # a text that others are edits of shares all its pairs with them; an edit has some of its own
    weight = lists.groupBy("cls").agg(F.sum("m").alias("w"))
    heads = lists.join(weight, "cls").groupBy("token").agg(F.max_by("cls", F.struct("w", "cls")).alias("head"))
    groups = stored(spark, lists.join(heads, "token").select("head", "cls").distinct(), "groups")
    discard(spark, lists)
    return groups


_SET = T.StructType([T.StructField("cls", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hashes", T.BinaryType())])
_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(cls, hi, lo, hashes): the full sets, with their digests, of the documents ``ids`` (cls).

    The texts are read again; a filter of fixed size drops nearly all other ids before their sets
    are made, and a join drops the rest.
    """
    place = F.pmod(F.xxhash64("cls"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(bits)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            at = batch.column(2).to_numpy()
            pick = np.flatnonzero((sent.value[at >> 6] >> (at & 63)) & 1)
            sets = [shingle_set(t, k) for t in batch.column(1).take(pa.array(pick)).to_pylist()]
            digests = [_digest(x) for x in sets]
            return {"cls": batch.column(0).to_numpy()[pick], "hi": [d[0] for d in digests], "lo": [d[1] for d in digests], "hashes": [x.tobytes() for x in sets]}

        return work

    return map_rows(docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("at")), _SET, make)


def _full(spark: SparkSession, groups: DataFrame, classes: DataFrame, docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """(cls, n, low, hashes) of all members, each once: the full set and the low halves of the coordinates, in which true collisions stay collisions."""
    ids = groups.select("cls").distinct()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            low = _rows_of(batch.column(4), coordinates).astype(np.uint16)
            return {"cls": batch.column(0), "n": batch.column(1), "hi": batch.column(2), "lo": batch.column(3), "low": [r.tobytes() for r in low]}

        return work

    lows = map_rows(classes.join(ids, "cls", "left_semi").select("cls", "n", "hi", "lo", "sig"), _BYTES, make)
    full = lows.join(_sets(spark, docs, ids, k), ["cls", "hi", "lo"])
    full = full.groupBy("cls").agg(F.min_by(F.struct("n", "low", "hashes"), F.struct("n", "hi", "lo")).alias("x")).select("cls", "x.*")
    return stored(spark, full, "sets")


_BYTES = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "n", "hi", "lo")] + [T.StructField("low", T.BinaryType())])


def _near(n: int, others: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n + others - common)


class _Side:
    """Members on one side of a comparison."""

    def __init__(self, table: pa.Table, coordinates: int):
        self.cls, self.n, self.root = (table.column(c).to_numpy().copy() for c in ("cls", "n", "root"))
        self.low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint16).reshape(-1, coordinates)
        self.flat = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)


def links_between(left: _Side, right: _Side, percent: int, matches: int) -> list[tuple[int, int]]:
    """Links between two sides that join components, in the order found.

    Pairs joined already, of too unlike sizes or of too few collisions aren't compared; what is
    left is confirmed on the full sets.
    """
    links, ids, mark = [], None, None
    for y in range(len(left.cls)):
        n = int(left.n[y])
        met = np.flatnonzero((right.root != left.root[y]) & (right.cls != left.cls[y]) & (100 * np.minimum(n, right.n) >= percent * np.maximum(n, right.n)))
        met = met[(right.low[met] == left.low[y]).sum(axis=1) >= matches]
        if not len(met):
            continue
        if ids is None:  # places of all hashes among those of both sides
            names, ids = np.unique(np.concatenate([right.flat, left.flat]), return_inverse=True)
            mark = np.zeros(len(names), np.int32)
        own = ids[len(right.flat) + left.starts[y] : len(right.flat) + left.starts[y + 1]]
        mark[own] = 1
        if 4 * len(met) > len(right.cls):
            common = np.add.reduceat(mark[ids[: len(right.flat)]], right.starts[:-1])[met]
        else:
            common = np.array([mark[ids[right.starts[x] : right.starts[x + 1]]].sum() for x in met])
        mark[own] = 0
        for x in met[_near(n, right.n[met], common, percent)]:
            if right.root[x] != left.root[y]:
                links.append((int(left.cls[y]), int(right.cls[x])))
                old = right.root[x]
                right.root[right.root == old] = left.root[y]
                left.root[left.root == old] = left.root[y]
    return links


def by_group(dealt: DataFrame, keys: int, found) -> DataFrame:
    """``found`` of each run of rows equal in the first ``keys`` columns, by which ``dealt`` is sorted in its partitions."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            at = [table.column(c).to_numpy() for c in range(keys)]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in at])) + 1
            ab = [p for s, e in zip([0, *change], [*change, table.num_rows]) for p in found(table.slice(s, e - s))]
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in ab], pa.int64()), pa.array([max(p) for p in ab], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch, and the first may have begun in the one before
            at = [batch.column(c).to_numpy() for c in range(keys)]
            start = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in at])))
            if held and (start or any(k[0] != held[0].column(c)[0].as_py() for c, k in enumerate(at))):
                yield out(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = []
            elif start:
                yield out(pa.Table.from_batches([batch.slice(0, start)]))
            held.append(batch.slice(start))
        if held:
            yield out(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, _LINK)


def _parts(rows, size) -> F.Column:
    return F.ceil(F.greatest(rows / F.lit(BLOCK), size / F.lit(BLOCK_BYTES))).cast("int")


def _stars(members: DataFrame, full: DataFrame, settings: Settings, coordinates: int, matches: int) -> DataFrame:
    """Links of each group's members (head, cls, n) with its head; a large group is dealt to several tasks, each with the head."""
    sizes = members.groupBy("head").agg(_parts(F.count(F.lit(1)), F.sum("n") * 8).alias("parts"), F.count(F.lit(1)).alias("m")).where("m > 1")
    every, one = F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = members.select("head", "cls").join(sizes, "head").select("head", "cls", F.explode(F.when(F.col("cls") == F.col("head"), every).otherwise(one)).alias("i"))
    dealt = dealt.join(full, "cls").select("head", "i", "cls", "n", F.col("cls").alias("root"), "low", "hashes")
    dealt = dealt.repartition("head", "i").sortWithinPartitions("head", "i", F.col("cls") != F.col("head"), "cls")
    percent = settings.percent

    def found(table: pa.Table) -> list:
        if table.num_rows < 2:
            return []
        left, right = _Side(table.slice(0, 1), coordinates), _Side(table.slice(1), coordinates)
        return links_between(left, right, percent, matches) if table.column("head")[0].as_py() == left.cls[0] else []

    return by_group(dealt, 2, found)


def _across(spark: SparkSession, members: DataFrame, full: DataFrame, roots: DataFrame, settings: Settings, coordinates: int, matches: int) -> DataFrame:
    """Links between components inside groups.

    Of two members of different components at least one is outside the group's largest one; those
    are the left side.  Blocks of the left side meet blocks of the whole group, so that no task
    holds more than two blocks.
    """
    at = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    at = stored(spark, at, "rooted", small=True)
    by = at.groupBy("head", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    by = by.groupBy("head").agg(F.max(F.struct("m", "root", "s")).alias("most"), F.sum("m").alias("m"), F.sum("s").alias("s")).where(F.col("m") > F.col("most.m"))
    by = by.select("head", F.col("most.root").alias("most"), _parts(F.col("m"), F.col("s") * 8).alias("right"), _parts(F.col("m") - F.col("most.m"), (F.col("s") - F.col("most.s")) * 8).alias("left"))
    open_ = at.join(by, "head").select("head", "cls", "root", "most", "right", "left")
    side = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    lefts = open_.where(F.col("root") != F.col("most")).select("head", side("left", 1).alias("i"), every("right").alias("j"), F.lit(0).alias("side"), "cls", "root")
    rights = open_.select("head", every("left").alias("i"), side("right", 2).alias("j"), F.lit(1).alias("side"), "cls", "root")
    dealt = lefts.unionByName(rights).join(full, "cls").select("head", "i", "j", "side", "cls", "n", "root", "low", "hashes")
    dealt = dealt.repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "side", "cls")
    percent = settings.percent

    def found(table: pa.Table) -> list:
        many = int((table.column("side").to_numpy() == 0).sum())
        if not many or many == table.num_rows:
            return []
        return links_between(_Side(table.slice(0, many), coordinates), _Side(table.slice(many), coordinates), percent, matches)

    return by_group(dealt, 3, found)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the smallest node that it reaches.

    Each round hooks nodes to their smallest neighbour, jumps along the hooks and contracts the
    links; the nodes left at least halve.
    """
    left = stored(spark, links.select("a", "b").where("a <> b"), "links", small=True)
    map_: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(spark, ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "hooks", small=True)
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
            hooks = stored(spark, jumped, "hooks", small=True)
            if hooks.where("moved").isEmpty():
                break
        roots = hooks.select("node", "root")
        if map_ is None:
            map_ = roots
        else:
            onto = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            map_ = stored(spark, map_.join(onto, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots", small=True)
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = stored(spark, left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links", small=True)
    return map_ if map_ is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def extended(spark: SparkSession, roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components ``roots`` (node, root) with the links ``more`` (a, b) between them."""
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = stored(spark, ends.join(roots, "node", "full").select("node", F.coalesce("root", "node").alias("root")), "roots", small=True)
    end = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    above = components(spark, more.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return every.join(above.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))


def find(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = stored(spark, signatures(docs, settings.words, coordinates), "signatures")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(spark, classes, "classes")
    posts = stored(spark, _postings(spark, classes, coordinates, matches), "postings")
    groups = groups_of(spark, posts)
    discard(spark, posts)
    full = _full(spark, groups, classes, docs, settings.words, coordinates)
    members = stored(spark, groups.join(full.select("cls", "n"), "cls"), "members")
    discard(spark, groups)
    links = stored(spark, _stars(members, full, settings, coordinates, matches), "stars")
    roots = components(spark, links)
    more = stored(spark, _across(spark, members, full, roots, settings, coordinates, matches), "across")
    discard(spark, members, full)
    if not more.isEmpty():
        roots = extended(spark, roots, more)
    rooted = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("hi", "lo", F.coalesce("root", "cls").alias("root"))
    ids = sets.select("doc_id", "n", "hi", "lo").join(rooted, ["hi", "lo"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The kept document of each group, with the input's columns.

    Of several rows with one id the one with the smallest hash of its text (ties by the text) stays; rows without
    an id all stay.
    """
    return by_position(docs, ("doc_id", "text"), lambda named: _deduplicated(spark, named, settings))


def _deduplicated(spark: SparkSession, docs: DataFrame, settings: Settings) -> DataFrame:
    gone = stored(spark, find(spark, docs, settings).where("not kept").select("doc_id"), "gone")
    named = docs.where(F.col("doc_id").isNotNull())
    left = named.join(gone, named["doc_id"] == gone["doc_id"], "left_anti")
    one = left.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return one.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
