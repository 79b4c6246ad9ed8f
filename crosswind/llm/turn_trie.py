"""Prefix trie of conversations by sorted matrices of turn ids.

A turn's id is the MD5 of its role and text, so that no text is shuffled.  Conversations are rebuilt from
the turns of their family, equal sequences become one row with a count, and the rows are dealt into range
shards by their sequences of ids.  In a shard, ids become padded matrices of local ranks that ``lexsort``
orders; masks of changed columns, OR-accumulated from left to right, mark where nodes start, and ``reduceat``
aggregates every depth.  A shard knows the last sequence before it and the first one after it, so it knows
which of its nodes other shards share.  Only those are recombined, by key; what they lack of their subtrees
comes from running sums over one row for each shard.

Defined results: turns go by turn number, null first, ties by role and then by the turn's id; null role or
text is the empty string; repeated rows are turns of their own; rows without an id belong to no conversation
and are left out; ``%`` is SQL's remainder, negative for negative ids; a table without conversations has no
nodes, as even the root needs a member; other columns of the input are ignored.  A conversation's ids (24
bytes a turn) have to fit into a task; texts of any length don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm._shared import discard, stored

#: Turns of distinct sequences in a shard, about; columns of a matrix; bits of an id that a list of ids ranges over.
SHARD_TURNS, COLUMNS, ID_BITS = 1_000_000, 16, 16
#: Conversations of a family share its first one's beginning, of up to ``HEADS - 1`` turns.
FAMILY, HEADS = 5, 9
_ID = 16

SEQUENCES = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("bytes", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("ends", T.StringType()),
])
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = T.StructType([*(T.StructField(n, T.LongType()) for n in _NODE), T.StructField("ends_sha256", T.StringType())])
#: What a shard says of its nodes.  ``key`` and ``parent_key`` are of nodes that other shards share; ``starts`` marks the shard where one starts.
PARTS = T.StructType([
    T.StructField("shard", T.IntegerType()), *NODES.fields, T.StructField("bytes", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("parent_key", T.StringType()), T.StructField("starts", T.BooleanType()),
])
_NO_ENDS = hashlib.sha256().hexdigest()


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation's ids (16 bytes a turn, one after the other) and bytes a turn, by the family rule."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text).cast("binary")).alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    turns = convs.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), family.cast("long").alias("family"), turn.alias("t")).repartition("family")
    light = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes")))
    families = turns.groupBy("family", "conv_id").agg(light.alias("turns")).groupBy("family").agg(F.collect_list(F.struct("conv_id", "turns")).alias("m"))
    base = F.get(F.filter("m", lambda x: x["conv_id"] == F.col("family")), F.lit(0))["turns"]
    own = families.select(F.explode("m").alias("c"), base.alias("base")).select("c.conv_id", F.col("c.turns").alias("own"), F.coalesce("base", F.slice("c.turns", 1, 0)).alias("base"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    whole = own.withColumn("head", head).select("conv_id", F.concat(F.slice("base", F.lit(1), F.col("head")), F.slice("own", F.col("head") + 1, F.size("own"))).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("ids"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))


def sequences(convs: DataFrame) -> DataFrame:
    """``SEQUENCES``: each distinct sequence with its number of conversations, the smallest id, and the digest of all ids in order.

    Ids meet in lists of one range of ``2 ** ID_BITS`` ids, and the lists of a sequence go through the
    digest one after the other, so that a sequence of a third of all conversations is never held.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    lists = rebuilt(convs).groupBy(F.md5("ids").alias("key"), F.shiftright("conv_id", ID_BITS).alias("range")).agg(
        F.first("ids").alias("ids"), F.first("bytes").alias("bytes"), F.sort_array(F.collect_list("conv_id")).alias("members")
    )
    texts = lists.select("key", "range", "ids", "bytes", F.col("members")[0].alias("first"), F.size("members").alias("n"), F.array_join(F.transform("members", lambda c: c.cast("string")), ",").alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, now = to_arrow_schema(SEQUENCES), None
        for batch in batches:
            done: list[list] = []
            keys, said, n = (batch.column(c).to_pylist() for c in ("key", "said", "n"))
            for k, key in enumerate(keys):
                if now is None or now[0] != key:
                    if now:
                        done.append([*now[1:5], now[5].hexdigest()])
                    now = [key, batch.column("ids")[k].as_py(), batch.column("bytes")[k].as_py(), 0, batch.column("first")[k].as_py(), hashlib.sha256()]
                else:
                    now[5].update(b",")
                now[3] += n[k]
                now[5].update(said[k].encode())
            yield _batch(done, into)
        if now:
            yield _batch([[*now[1:5], now[5].hexdigest()]], into)

    return texts.repartition("key").sortWithinPartitions("key", "range").mapInArrow(run, SEQUENCES)


def _batch(rows: list[list], into: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(into)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, into, strict=True)], schema=into)


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences share from their beginning; -1 where there is none to compare with."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // _ID
    x, y = (np.frombuffer(s[: n * _ID], "u1").reshape(n, _ID) for s in (a, b))
    return int(np.argmin(np.concatenate([(x == y).all(1), [False]])))


class Shard:
    """The sorted distinct sequences of a shard, and matrices of ``COLUMNS`` depths of those rows that reach them."""

    def __init__(self, ids: np.ndarray, n_turns: np.ndarray):
        #: ids: two unsigned numbers a turn, turns of all rows one after the other.
        order = np.lexsort((ids[:, 1], ids[:, 0]))
        new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]).any(1)]) if len(ids) else np.empty(0, bool)
        rank = np.empty(len(ids), "i4")
        rank[order] = np.cumsum(new) - 1
        self.at = np.cumsum(n_turns) - n_turns  # of a row's first turn
        self.n_turns, self.rank = n_turns, rank
        self.order = np.arange(len(n_turns))
        #: For each block of depths: the places of its rows in the order, its matrix, and where a row differs from the row above up to a depth.
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        places, group = np.arange(len(n_turns)), np.zeros(len(n_turns), "i8")
        first = 0
        while True:
            m = self.matrix(self.order[places], first)
            ends_here = self.n_turns[self.order[places]] <= first + COLUMNS
            inside = np.lexsort((~ends_here, *m.T[::-1], group))
            self.order[places], m, group = self.order[places][inside], m[inside], group[inside]
            changed = np.logical_or.accumulate((m[1:] != m[:-1]) | (group[1:] != group[:-1])[:, None], axis=1)
            mask = np.concatenate([np.ones((min(len(m), 1), COLUMNS), bool), changed])
            self.blocks.append((places, m, mask))
            first += COLUMNS
            deeper = self.n_turns[self.order[places]] > first
            if not deeper.any():
                break
            group = (np.cumsum(mask[:, -1]) - 1)[deeper]
            places = places[deeper]

    def matrix(self, rows: np.ndarray, first: int) -> np.ndarray:
        depth = np.arange(first, first + COLUMNS)
        inside = depth < self.n_turns[rows][:, None]
        m = np.full(inside.shape, -1, "i4")
        m[inside] = self.rank[(self.at[rows][:, None] + depth)[inside]]
        return m

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For every depth from 1: its block's places, bounds of runs there and which of them are nodes; where nodes start and end in the order."""
        for k, (places, m, mask) in enumerate(self.blocks):
            for c in range(min(COLUMNS, int(self.n_turns.max(initial=0)) - k * COLUMNS)):
                bounds = np.flatnonzero(mask[:, c])
                real = m[bounds, c] >= 0
                #: All rows of a node reach its depth, so that they lie side by side in the order too.
                ends = places[np.concatenate([bounds[1:], [len(places)]]) - 1] + 1
                yield k * COLUMNS + c + 1, places, bounds, places[bounds][real], ends[real], real


class Level:
    """The nodes of one depth in a shard, in order."""

    def __init__(self, depth: int, start: np.ndarray, end: np.ndarray, convs: np.ndarray, smallest: np.ndarray):
        self.depth, self.start, self.end, self.convs, self.smallest = depth, start, end, convs, smallest

    def holding(self, start: np.ndarray) -> np.ndarray:
        """Numbers of the nodes in which the rows at ``start`` lie."""
        return np.searchsorted(self.start, start, "right") - 1


def shard_nodes(table: dict[str, list | np.ndarray], before: bytes | None, after: bytes | None) -> dict[str, np.ndarray]:
    """Columns of ``PARTS`` but ``shard``, for the sequences of a shard between its neighbours' next ones."""
    n_turns, rows = table["n_turns"], len(table["n_turns"])
    shard = Shard(np.frombuffer(b"".join(table["ids"]), ">u8").astype("u8").reshape(-1, 2), n_turns)
    order = shard.order
    n, first, length, at = table["n"][order], table["first"][order], n_turns[order], shard.at[order]
    ends = np.array(table["ends"], object)[order]
    heads, tails = table["ids"][order[0]], table["ids"][order[-1]]
    shared_in, shared_out = _common(before, heads), _common(tails, after)
    keys = _keys(heads, shared_in), _keys(tails, shared_out)
    levels = [Level(0, np.zeros(1, "i8"), np.full(1, rows), n.sum(keepdims=True), first.min(keepdims=True))]
    for depth, places, bounds, start, end, real in shard.runs():
        levels.append(Level(depth, start, end, np.add.reduceat(n[places], bounds)[real], np.minimum.reduceat(first[places], bounds)[real]))
    #: What a row adds by the nodes that start there; what nodes above the depth at hand add of that.
    saved, leaves, above = np.zeros(rows, "i8"), np.zeros(rows, "i8"), np.zeros(rows, "i8")
    for x in levels:
        x.size = table["bytes"][at[x.start] + x.depth - 1] if x.depth else np.zeros(1, "i8")
        x.enters, leaving = (x.start == 0) & (x.depth <= shared_in), (x.end == rows) & (x.depth <= shared_out)
        x.shared = x.enters | leaving
        x.own = np.where(x.shared, 0, (x.convs - 1) * x.size)
        x.ended = length[x.start] == x.depth  # the first row of a node is the shortest
        saved[x.start] += x.own
        leaves[x.start] += x.ended & (x.end - x.start == 1) & ~x.shared
    run_saved, run_leaves = (np.concatenate([[0], np.cumsum(v)]) for v in (saved, leaves))
    out: dict[str, list[np.ndarray]] = {}
    for x, up, down in zip(levels, [None, *levels], [*levels[1:], None], strict=False):
        children = np.zeros(len(x.start), "i8")
        if down:
            np.add.at(children, x.holding(down.start), ~down.enters)
        key, parent, parent_key = (np.full(len(x.start), None, object) for _ in range(3))
        for i in np.flatnonzero(x.shared):
            key[i] = keys[0 if x.enters[i] else 1][x.depth]
        if up:
            held = up.holding(x.start)
            parent[:] = up.smallest[held]
            for i in np.flatnonzero(up.shared[held]):
                parent[i], parent_key[i] = None, up.key[held[i]]
        x.key = key
        columns = {
            "conv_id": x.smallest, "depth": np.full(len(x.start), x.depth), "parent_conv_id": parent, "n_convs": x.convs, "n_children": children,
            "n_leaves": run_leaves[x.end] - run_leaves[x.start], "saved_tokens": run_saved[x.end] - run_saved[x.start] - above[x.start],
            "ends_sha256": np.where(x.ended, ends[x.start], _NO_ENDS), "bytes": x.size, "key": key, "parent_key": parent_key, "starts": ~x.enters,
        }
        for name, column in columns.items():
            out.setdefault(name, []).append(column)
        above[x.start] += x.own
    return {name: np.concatenate(columns) for name, columns in out.items()}


def _keys(sequence: bytes, depth: int) -> list[str]:
    """The keys of a sequence's prefixes of 0 to ``depth`` turns."""
    digest, out = hashlib.md5(), [hashlib.md5().hexdigest()]
    for k in range(depth):
        digest.update(sequence[k * _ID : (k + 1) * _ID])
        out.append(f"{digest.hexdigest()}-{k + 1}")
    return out


def sharded(spark: SparkSession, convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``SEQUENCES`` in range shards by their ids, stored, with the shard's number."""
    whole = stored(spark, sequences(convs), "sequences")
    turns = whole.agg(F.sum(F.size("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    table = stored(spark, whole.repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()), "shards")
    discard(spark, whole)
    return table


def edges(table: DataFrame) -> DataFrame:
    """For each shard the last sequence before it and the first one after it: one row a shard, in one task."""
    ends = table.groupBy("shard").agg(F.min("ids").alias("head"), F.max("ids").alias("tail"))
    order = Window.orderBy("shard")
    return ends.select("shard", F.lag("tail").over(order).alias("before"), F.lead("head").over(order).alias("after"))


def parts(table: DataFrame) -> DataFrame:
    """``PARTS`` of all shards."""

    def nodes(rows: pa.Table, edge: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = rows.combine_chunks()
        sizes = rows.column("bytes").combine_chunks()
        flat = {"ids": rows.column("ids").to_pylist(), "bytes": sizes.flatten().to_numpy(), "n_turns": sizes.value_lengths().to_numpy().astype("i8"), "ends": rows.column("ends").to_pylist()}
        out = shard_nodes(flat | {c: rows.column(c).to_numpy() for c in ("n", "first")}, edge.column("before")[0].as_py(), edge.column("after")[0].as_py())
        out["shard"] = np.full(len(out["depth"]), rows.column("shard")[0].as_py())
        into = to_arrow_schema(PARTS)
        return pa.table([pa.array(out[f.name], f.type) for f in into], schema=into)

    return table.groupBy("shard").cogroup(edges(table).groupBy("shard")).applyInArrow(nodes, PARTS)


def recombined(shared: DataFrame) -> DataFrame:
    """Whole nodes of the parts that several shards have, by ``key``.

    Sums of parts lack only what shared nodes themselves save.  Those that start in a node's subtree are, in the shard
    where it starts, the deeper ones that start there, and all that start in later shards up to the node's last.
    """
    total = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("inside"), F.max(F.when(F.col("starts"), F.col("ends_sha256"))).alias("ends_sha256"), F.max(F.when(F.col("starts"), F.col("bytes"))).alias("bytes"),
        F.min("shard").alias("from_shard"), F.max("shard").alias("to_shard"),
    ).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    deeper = total.withColumn("chain", F.sum("own").over(Window.partitionBy("from_shard").orderBy(F.desc("depth"))))
    started = total.groupBy(F.col("from_shard").alias("shard")).agg(F.sum("own").alias("q"))
    running = shared.select("shard").distinct().join(started, "shard", "left").select("shard", F.coalesce("q", F.lit(0)).alias("q")).withColumn("run", F.sum("q").over(Window.orderBy("shard")))
    first, last = running.select(F.col("shard").alias("from_shard"), F.col("run").alias("from_run")), running.select(F.col("shard").alias("to_shard"), (F.col("run") - F.col("q")).alias("to_run"))
    #: In its last shard a node ends before any shared node starts that isn't above it, so that shard adds nothing.
    whole = deeper.join(first, "from_shard").join(last, "to_shard")
    return whole.select("key", "conv_id", "depth", "parent_key", "n_convs", "n_children", "n_leaves", (F.col("inside") + F.col("chain") + F.col("to_run") - F.col("from_run")).alias("saved_tokens"), "ends_sha256")


def trie(spark: SparkSession, convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``NODES``: every node of the trie of rebuilt conversations."""
    table = sharded(spark, convs, shard_turns)
    nodes = stored(spark, parts(table), "trie-parts")
    discard(spark, table)
    shared = nodes.where(F.col("key").isNotNull())
    whole = stored(spark, recombined(shared), "trie-shared", small=True)
    names = [f.name for f in NODES]
    #: A parent's id goes to each shard that shares the parent, so that no task meets all children of the root.
    known = shared.select("shard", "key").join(whole.select("key", F.col("conv_id").alias("parent")), "key").select("shard", F.col("key").alias("parent_key"), "parent")
    mine = nodes.where(F.col("key").isNull() & F.col("parent_key").isNotNull()).join(known, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("parent"))
    above = whole.join(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent")), "parent_key", "left").withColumn("parent_conv_id", F.col("parent"))
    return nodes.where(F.col("key").isNull() & F.col("parent_key").isNull()).select(names).unionByName(mine.select(names)).unionByName(above.select(names))


#: The trie by all prefixes and all pairs of nodes: for small tables.  ``crc`` is CRC-32 bit by bit.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(octet_length(encode(role)) || ' ' || role || text ORDER BY turn NULLS FIRST, role, text) AS w, list(octet_length(encode(text)) ORDER BY turn NULLS FIRST, role, text) AS b FROM t GROUP BY conv_id),
h AS (SELECT *, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
 lambda s, x: list_reduce(list_prepend(xor(s, x), list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda y, i: xor(y >> 1, CAST(3988292384 AS UBIGINT) * (y & 1))))) % 9 AS BIGINT) AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w, list_concat(coalesce(b.b, [])[1:h.h], h.b[h.h + 1:]) AS b FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d AS depth, w[1:d] AS k, w[1:d - 1] AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS size, len(w) = d AS ends FROM r, unnest(range(0, len(w) + 1)) u(d)),
n AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY k, depth),
ch AS (SELECT a.k, count(b.k) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.up = a.k GROUP BY a.k),
s AS (SELECT a.k, CAST(sum((b.n_convs - 1) * b.size) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves FROM n a JOIN n b ON b.depth >= a.depth AND b.k[1:a.depth] = a.k JOIN ch x ON x.k = b.k GROUP BY a.k)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, ch.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN ch ON ch.k = n.k JOIN s ON s.k = n.k LEFT JOIN n q ON n.depth > 0 AND q.k = n.up"""
