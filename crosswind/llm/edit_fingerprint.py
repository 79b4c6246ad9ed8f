"""Fingerprints by randomised edit embedding.

A walk reads a text: at step j it writes the character that it stands on and goes on by one if a
shared random bit of (j, character) says so.  Two texts at a small edit distance have walks that
meet again soon after each edit, so their written strings differ in few places: edit distance
becomes Hamming distance.  The fingerprint samples that string.  Each slot has its own random
order of steps and takes the first step of it that the walk made, so that texts of like length
sample like places; it keeps a byte of the characters written there.  The part of equal slots
estimates the likeness.  Bands of sampled slots are keys under which like texts meet; a met pair is
verified by its whole fingerprints, and verified pairs link documents to groups.

Walks of many texts run side by side in NumPy, over the whole texts.

Defined results: null text is the empty text, whose fingerprint is fixed; equal texts have equal
fingerprints; the next document is by ascending id (ties by packed text), after the last the first, and
of a table of one row the row itself; texts of any length are walked to their end; a null id comes first; repeated
rows follow each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import discard, map_rows, stored
from crosswind.llm.near_dup import by_group, components, extended, groups_of

SLOTS = 128
#: Bands, slots sampled for each, and the likeness from which texts are near.  73 bands of 4 slots miss a pair of likeness 0.6 with chance 0.00004,
#: and unlike texts meet in 1 of 25 million bands by chance.
BANDS = 73
BAND = 4
LEAST = 0.6
#: Members of a block of a band's group; a fingerprint with over one in so many rows is joined without a shuffle.
BLOCK = 512
MOST_SHARE = 2000
#: Characters written in a row that a slot keeps a byte of.
RUN = 4
SEED = 20_240_607
#: Random bits of a step are looked up by the character's code modulo this, and repeat after this many steps.
ALPHABET = 128
PERIOD = 1 << 16
#: Texts, and characters of the longest times their number, that walk side by side.
SIDE_BY_SIDE = 4096
CELLS = 24_000_000

RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])


def _bits() -> np.ndarray:
    """Column 0 is the cell after a text, where a walk stays."""
    out = np.random.default_rng(SEED).integers(0, 2, (PERIOD, ALPHABET), dtype=np.uint8)
    out[:, 0] = 0
    return out


def _records(slots: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each slot the steps that come first in its order among all steps so far, up to ``most``.

    In a random order step j (from 1) is such a record with chance 1 / j; after a record at j
    the next is ceil(j / u) for a uniform u.
    """
    out = []
    for s in range(slots):
        rng, at, mine = np.random.default_rng([SEED, s]), 1, []
        while at <= most:
            mine.append(at - 1)
            at = int(min(max(at + 1, np.ceil(at / rng.random())), most + 1))
        out.append(np.array(mine, np.int64))
    return out, np.unique(np.concatenate(out))


class Walker:
    def __init__(self, slots: int = SLOTS):
        self.slots, self.bits = slots, _bits()
        self.most, self.records, self.wanted = 0, [], np.zeros(0, np.int64)

    def _know(self, steps: int) -> None:
        if steps > self.most:
            self.most = max(1 << 18, 1 << int(steps).bit_length())
            self.records, self.wanted = _records(self.slots, self.most)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """A row of ``slots`` bytes for each text."""
        out = np.zeros((len(texts), self.slots), np.uint8)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(codes[i]))
        at = 0
        while at < len(order):
            longest = max(1, len(codes[order[at]]))
            many = max(1, min(SIDE_BY_SIDE, CELLS // longest))
            lot = order[at : at + many]
            # a lot holds texts of about one length: no lane waits long for another
            lot = [i for i in lot if 10 * len(codes[i]) >= 7 * longest or longest <= 64]
            out[lot] = self._walk([codes[i] for i in lot])
            at += len(lot)
        return out

    def _walk(self, codes: list[np.ndarray]) -> np.ndarray:
        lanes, sizes = len(codes), np.array([len(c) for c in codes], np.int64)
        # at a chance of a half for each step on, about twice as many steps as characters; steps late for a text's length all go on, so that every walk ends
        late = 3 * sizes + 64
        most = int((late + sizes).max()) if lanes else 0
        if not lanes or not sizes[0]:
            return np.zeros((lanes, self.slots), np.uint8)
        self._know(most)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        flat = np.zeros(int(sizes.sum()) + lanes, np.uint32)
        for s, c in zip(starts, codes):
            flat[s : s + len(c)] = c
        low = (flat % (ALPHABET - 1) + 1).astype(np.uint8)
        ends = starts + sizes
        low[ends] = 0
        wanted = self.wanted[: np.searchsorted(self.wanted, most)]
        need = np.zeros(most + RUN, bool)
        for r in range(RUN):
            need[wanted + r] = True
        kept_at = np.cumsum(need) - 1
        kept = np.zeros((int(need.sum()), lanes), np.uint32)
        inside = np.zeros((len(kept), lanes), bool)
        pos, bits, soon, last = starts.copy(), self.bits, int(late.min()), int(late.max())
        for j in range(most + RUN):
            here = low[pos]
            if need[j]:
                kept[kept_at[j]] = flat[pos]
                inside[kept_at[j]] = here > 0
            if not j & 63 and not here.any():
                break  # what is written beyond the end is 0
            if j < soon:
                pos += bits[j & (PERIOD - 1)][here]
            else:
                pos += np.where(j < late, bits[j & (PERIOD - 1)][here], here > 0) if j < last else here > 0
        # bytes of the written characters at each wanted step
        value = np.zeros((len(wanted), lanes), np.uint64)
        for r in range(RUN):
            value = (value ^ kept[kept_at[wanted + r]]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        value = (value * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8)
        made = inside[kept_at[wanted]].sum(axis=0)  # wanted steps that a lane made before its end
        out = np.zeros((lanes, self.slots), np.uint8)
        own = np.arange(lanes)
        for s, mine in enumerate(self.records):
            rows = np.searchsorted(wanted, mine[mine < most])
            last = np.searchsorted(rows, made, side="left") - 1  # the last record among a lane's own steps
            ok = last >= 0
            out[ok, s] = value[rows[np.maximum(last, 0)], own][ok]
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of equal slots, less what chance gives, of rows of fingerprints."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return (text[: len(text) - n] + following[:n]) if n else text


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key, by halving."""
    steps, all_bounds = [1 << i for i in reversed(range(len(bounds).bit_length()))], F.array(*[F.lit(b).cast("long") for b in bounds])
    fits = lambda acc, s: (acc + s <= len(bounds)) & (F.try_element_at(all_bounds, acc + s) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when(fits(acc, s), acc + s).otherwise(acc))


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (bucket, tail, doc_id, text), each bucket a range of ids with the next range's first row as its tail.

    The bounds are quantiles of the ids alone; the first row of each range, one for each bound,
    goes to two buckets.  The texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))  # rows without an id come first
    bucket = _bucket(key, bounds) if bounds else F.lit(0)
    ids = docs.select(key.alias("key"), bucket.alias("bucket")).groupBy("bucket").agg(F.min("key").alias("first")).collect()
    firsts = sorted((r["bucket"], r["first"]) for r in ids)  # one for each range: as many as there are bounds
    if not firsts:
        return docs.select(F.lit(0).alias("bucket"), F.lit(0).alias("tail"), "doc_id", "text"), 1
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    rows = docs.select("doc_id", "text", bucket.alias("bucket"))
    small = docs.sparkSession.createDataFrame(list(before.items()), "key long, bucket int")  # a row for each range
    wanted = rows.drop("bucket").withColumn("key", key).join(F.broadcast(small), "key")
    tails = wanted.select("bucket", F.lit(1).alias("tail"), "doc_id", "text")
    return rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails), len(firsts)


def _named(raw: DataFrame) -> DataFrame:
    """Fingerprints as text."""
    return raw.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def fingerprint_with_edit(spark: SparkSession, docs: DataFrame, parts: int | None = None, slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how near they are; see the module."""
    return _named(_raw(spark, docs, parts, slots))


_PACKED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("tail", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("packed", T.BinaryType())])


def _packed(rows: DataFrame) -> DataFrame:
    """The texts compressed, as all of them are shuffled."""

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(3).to_pylist()
            return {"bucket": batch.column(0), "tail": batch.column(1), "doc_id": batch.column(2), "packed": [squeeze(t.encode("utf-8", "surrogatepass")) for t in texts]}

        return work

    return map_rows(rows.select(F.col("bucket").cast("int"), F.col("tail").cast("int"), "doc_id", "text"), _PACKED, make)


def _raw(spark: SparkSession, docs: DataFrame, parts: int | None, slots: int = SLOTS) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, buckets = with_next(docs, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        into, walker, unpack = to_arrow_schema(RESULT), Walker(slots), zstandard.ZstdDecompressor().decompress

        def out(group: list[tuple[int, str]]) -> pa.RecordBatch:
            """All rows but the last, which is only the next of the one before it."""
            own = [t for _, t in group[:-1]]
            changed = [edited(t, f) for t, (_, f) in zip(own, group[1:])]
            got = walker.fingerprints([*own, group[-1][1], *changed])
            n = len(own)
            mine, follow, after = got[:n], got[1 : n + 1], got[n + 1 :]
            for i, (a, b) in enumerate(zip(own, changed)):
                if a == b:
                    after[i] = mine[i]
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in group[:-1]], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]), pa.array([r.tobytes() for r in mine]),
                pa.array([r.tobytes() for r in after]), pa.array(likeness(mine, after)), pa.array(likeness(mine, follow)),
            ], schema=into)

        held: list[tuple[int, str]] = []
        last_bucket, size = None, 0
        tail: tuple[int, str] | None = None
        for batch in batches:
            for bucket, is_tail, doc_id, packed in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack(packed).decode("utf-8", "surrogatepass")
                if bucket != last_bucket:
                    if len(held) > 1:
                        yield out(held)
                    held, size, last_bucket, tail = [], 0, bucket, None
                if is_tail and tail is not None:
                    continue  # of several rows with the first id, the first by its packed text
                if is_tail:
                    tail = (doc_id, text)
                held.append((doc_id, text))
                size += len(text)
                if len(held) > 2000 or size > 12_000_000:
                    yield out(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield out(held)

    dealt = _packed(rows).repartition(max(1, min(buckets, parts)), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "packed")
    return dealt.select("bucket", "tail", "doc_id", "packed").mapInArrow(run, RESULT)


def _sampled(slots: int, band: int, bands: int = BANDS) -> list[list[int]]:
    """The slots of each band: a seeded sample, none twice in a band."""
    rng = np.random.default_rng([SEED, slots, band])
    return [sorted(int(i) for i in rng.choice(slots, min(band, slots), replace=False)) for _ in range(bands)]


_POSTED = T.StructType([T.StructField("token", T.LongType()), T.StructField("cls", T.LongType())])


def _bands(one: DataFrame, band: int, slots: int = SLOTS) -> DataFrame:
    """(token, cls) of tokens that several classes have: the sampled slots of each fingerprint, hashed with the band's number.

    Rows are shuffled once and read in order; a token's row is told when another one follows, so no
    list is held.
    """
    token = lambda b, at: F.xxhash64(F.lit(b), *[F.substr("row", F.lit(i + 1), F.lit(1)) for i in at])
    every = one.select(F.explode(F.array(*[token(b, at) for b, at in enumerate(_sampled(slots, band))])).alias("token"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, cls = (batch.column(c).to_numpy() for c in range(2))
            if last is not None:
                tokens, cls = np.concatenate([[last[0]], tokens]), np.concatenate([[last[1]], cls])
            same = tokens[1:] == tokens[:-1]
            shared = np.zeros(len(tokens), bool)
            shared[1:] |= same
            shared[:-1] |= same
            told = shared.copy()
            told[-1] = False  # it may be told with the next batch
            if last is not None and last[2]:
                told[0] = True
            yield pa.RecordBatch.from_arrays([pa.array(tokens[told]), pa.array(cls[told])], names=["token", "cls"])
            last = (tokens[-1], cls[-1], bool(shared[-1]))
        if last is not None and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], names=["token", "cls"])

    return every.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(run, _POSTED)


class _Side:
    """Members on one side of a comparison."""

    def __init__(self, table: pa.Table):
        self.cls, self.root = (table.column(c).to_numpy().copy() for c in ("cls", "root"))
        self.rows = np.frombuffer(b"".join(table.column("row").to_pylist()), np.uint8).reshape(len(self.cls), -1)


def _links_between(left: _Side, right: _Side, least: float) -> list[tuple[int, int]]:
    """Verified pairs of two sides that join components, in the order found; pairs joined already aren't compared."""
    links = []
    for y in range(len(left.cls)):
        met = np.flatnonzero((right.root != left.root[y]) & (right.cls != left.cls[y]))
        for x in met[likeness(left.rows[y][None], right.rows[met]) >= least] if len(met) else ():
            if right.root[x] != left.root[y]:
                links.append((int(left.cls[y]), int(right.cls[x])))
                old = right.root[x]
                right.root[right.root == old] = left.root[y]
                left.root[left.root == old] = left.root[y]
    return links


def _parts(n) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _stars(members: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Links of each group's members with its head; a large group is dealt to several tasks, each with the head."""
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("parts", _parts(F.col("m")))
    every, one = F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = members.join(sizes, "head").select("head", "cls", F.explode(F.when(F.col("cls") == F.col("head"), every).otherwise(one)).alias("i")).join(rows, "cls")
    dealt = dealt.select("head", "i", "cls", F.col("cls").alias("root"), "row").repartition("head", "i").sortWithinPartitions("head", "i", F.col("cls") != F.col("head"), "cls")
    return by_group(dealt, 2, lambda t: _links_between(_Side(t.slice(0, 1)), _Side(t.slice(1)), least) if t.num_rows > 1 else [])


def _across(members: DataFrame, rows: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links between components inside groups: members outside a group's largest component against all, by blocks of both sides."""
    at = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    by = at.groupBy("head", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("head").agg(F.max(F.struct("m", "root")).alias("most"), F.sum("m").alias("m")).where(F.col("m") > F.col("most.m"))
    by = by.select("head", F.col("most.root").alias("most"), _parts(F.col("m")).alias("right"), _parts(F.col("m") - F.col("most.m")).alias("left"))
    open_ = at.join(by, "head")
    side = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "cls"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    lefts = open_.where(F.col("root") != F.col("most")).select("head", side("left", 1).alias("i"), every("right").alias("j"), F.lit(0).alias("side"), "cls", "root")
    rights = open_.select("head", every("left").alias("i"), side("right", 2).alias("j"), F.lit(1).alias("side"), "cls", "root")
    dealt = lefts.unionByName(rights).join(rows, "cls").select("head", "i", "j", "side", "cls", "root", "row").repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "side", "cls")

    def found(table: pa.Table) -> list:
        many = int((table.column("side").to_numpy() == 0).sum())
        return _links_between(_Side(table.slice(0, many)), _Side(table.slice(many)), least) if 0 < many < table.num_rows else []

    return by_group(dealt, 3, found)


def _linked(spark: SparkSession, one: DataFrame, band: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) of the classes ``one``, and the (node, root) of their components.

    Bands are grouped by their most shared fingerprint, the head; members are verified against it,
    so that edits of one text become a component, and where a group still holds several components
    the members outside the largest are verified against all others.
    """
    keys = stored(spark, _bands(one, band), "bands")
    members = groups_of(spark, keys)
    discard(spark, keys)
    rows = stored(spark, one.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "row"), "rows")
    links = stored(spark, _stars(members, rows, least), "links")
    roots = components(spark, links)
    more = stored(spark, _across(members, rows, roots, least), "more")
    if not more.isEmpty():
        links, roots = links.unionByName(more), extended(spark, roots, more)
    return links, roots


def _classes(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """Documents (doc_id, row) with equal fingerprints stand for each other: the first id and the number of each."""
    one = prints.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return stored(spark, one.select(F.xxhash64("row").alias("cls"), "row", "doc_id", "copies"), "prints")


def near_pairs(prints: DataFrame, band: int = BAND, least: float = LEAST) -> DataFrame:
    """Pairs (a, b, near) of different fingerprints that share a band and are verified as near.

    ``prints`` (doc_id, fingerprint) is first made distinct by fingerprint, so copies cost nothing.
    The pairs link all near fingerprints that share a band: a pair not among them is linked
    through others.
    """
    spark = prints.sparkSession
    one = _classes(spark, prints.select("doc_id", F.unhex("fingerprint").alias("row")))
    links, _ = _linked(spark, one, band, least)
    named = lambda c: one.select(F.col("cls").alias(c), F.col("doc_id").alias(f"{c}_id"), F.col("row").alias(f"{c}_row"))

    @F.pandas_udf("double")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        rows = [np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (x, y)]
        return pd.Series(likeness(*rows))

    both = links.join(named("a"), "a").join(named("b"), "b")
    return both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), near("a_row", "b_row").alias("near"))


def with_groups(spark: SparkSession, docs: DataFrame, parts: int | None = None, band: int = BAND, least: float = LEAST) -> DataFrame:
    """``fingerprint_with_edit`` and near_group, the first id that near fingerprints link a document to."""
    table = stored(spark, _raw(spark, docs, parts).withColumn("cls", F.xxhash64("fingerprint")), "fingerprints")
    one = _classes(spark, table.select("doc_id", F.col("fingerprint").alias("row")))
    _, roots = _linked(spark, one, band, least)
    rooted = one.select("cls", "doc_id", "copies").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("near_group"))
    groups = stored(spark, rooted.join(first, "root").select("cls", "copies", "near_group"), "groups")
    discard(spark, one)
    # fingerprints of many copies are few: their rows aren't dealt by fingerprint
    many = max(1, table.count() // MOST_SHARE)
    heavy = groups.where(F.col("copies") > many).select("cls", F.col("near_group").alias("heavy"))
    both = table.join(F.broadcast(heavy), "cls", "left")
    names = [*RESULT.fieldNames(), "near_group"]
    light = both.where("heavy is null").join(groups.select("cls", "near_group"), "cls")
    return _named(light.select(*names).unionByName(both.where("heavy is not null").withColumn("near_group", F.col("heavy")).select(*names)))
