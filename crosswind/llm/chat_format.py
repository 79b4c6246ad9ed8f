"""Chat formatting at the level of tokens.

Every turn becomes ``open role body text close``.  Roles and texts are encoded as segments of their
own, the three control strings are single ids beyond the vocabulary that are spliced between the
segments, and the loss mask comes from prefix sums over the places where learned text begins and ends.
Control strings inside roles and texts are escaped by one backslash after their first character, one
more than they have there already, which is undone exactly.

Defined results: turns go by turn number, null first, then by role and text; null role or text is the
empty string; repeated rows are turns of their own; rows without an id form one conversation without an
id; roles are any strings; strings of the vocabulary's special tokens in a text are ordinary text; an
empty table gives an empty result; other columns of the input are ignored.  A conversation is one row of
the result and has to fit into a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosswind.llm import _tokens
from crosswind.llm._shared import map_rows

FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("input_ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())),
])
DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])
#: A conversation with control strings in its texts, which the query adds to the table's.
TRICKY_ID = -7
TRICKY = r"\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Template:
    """Control strings, and the roles whose texts are learned.

    No control string may lie in another one, or end as it or another one begins: then escaping one
    never makes another.  With ``learn_close`` the id that closes a learned text is learned too.
    """

    open: str = "### "
    body: str = ":\n"
    close: str = "</turn>"
    learned: tuple[str, ...] = ("assistant",)
    learn_close: bool = False

    def __post_init__(self):
        every = (self.open, self.body, self.close)
        for s in every:
            if len(s) < 2 or "\\" in s:
                raise ValueError(f"not a control string: {s!r}")
            for t in every:
                if s is not t and s in t or any(s.endswith(t[:k]) for k in range(1, min(len(s), len(t)))):
                    raise ValueError(f"control strings overlap: {s!r}, {t!r}")

    def escape(self, text: str, role: bool = False) -> str:
        return _pattern(self.controls(role)).sub(r"\1\\\2", text)

    def unescape(self, text: str, role: bool = False) -> str:
        return _pattern(self.controls(role), "\\\\").sub(r"\1\2", text)

    def controls(self, role: bool) -> tuple[str, ...]:
        """Those escaped: a text is ended by ``close`` alone, a role by ``body`` too."""
        return (self.open, self.body, self.close) if role else (self.open, self.close)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a rendered conversation, by its control strings alone."""
        turns = []
        for turn in formatted.split(self.close)[:-1]:
            role, text = turn.removeprefix(self.open).split(self.body, 1)
            turns.append((self.unescape(role, True), self.unescape(text)))
        return turns


_PATTERNS: dict[tuple, re.Pattern] = {}


def _pattern(controls: tuple[str, ...], first: str = "") -> re.Pattern:
    """A control string with any number of backslashes after its first character, at least those of ``first``."""
    if (controls, first) not in _PATTERNS:
        heads = "|".join(rf"{re.escape(s[0])}(?={first}\\*{re.escape(s[1:])})" for s in controls)
        _PATTERNS[controls, first] = re.compile(rf"({heads}){first}(\\*)")
    return _PATTERNS[controls, first]


def ordered_turns(convs: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order."""
    clean = convs.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of segments of these lengths that begin at ``starts``, one segment after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def assemble(encode, first_free: int, roles: list[str], texts: list[str], template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and mask of turns one after the other, and the turns' lengths in ids."""
    known: dict[str, np.ndarray] = {}
    for role in roles:
        if role not in known:
            known[role] = encode(template.escape(role, True))
    heads, bodies = [known[r] for r in roles], [encode(template.escape(t)) for t in texts]
    n_head, n_body = np.array([len(x) for x in heads], "i8"), np.array([len(x) for x in bodies], "i8")
    length = n_head + n_body + 3
    at = np.cumsum(length) - length
    ids = np.empty(int(length.sum()), "i4")
    ids[at], ids[at + 1 + n_head], ids[at + length - 1] = first_free, first_free + 1, first_free + 2
    if len(roles):
        ids[_spread(at + 1, n_head)] = np.concatenate(heads)
        ids[_spread(at + 2 + n_head, n_body)] = np.concatenate(bodies)
    learned = np.array([r in template.learned for r in roles], bool)
    steps = np.zeros(len(ids) + 1, "i4")
    np.add.at(steps, (at + 2 + n_head)[learned], 1)
    np.add.at(steps, (at + length - (0 if template.learn_close else 1))[learned], -1)
    return ids, np.cumsum(steps[:-1]).astype("i1"), length


def format_conversations(convs: DataFrame, template: Template | None = None, vocabulary: str | None = None) -> DataFrame:
    """``FORMATTED``: each conversation's ids with its loss mask.  ``vocabulary`` is a path that executors have too.

    The control strings' ids are the first three beyond the vocabulary, in the order open, body, close.
    """
    template = template or Template()

    def make():
        tokens = _tokens.byte_bpe(vocabulary)

        def rows(batch: pa.RecordBatch) -> dict:
            lists = batch.column("turns")
            turns = lists.flatten()
            ids, mask, length = assemble(tokens.encode, tokens.size, turns.field("role").to_pylist(), turns.field("text").to_pylist(), template)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
            ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n)])]
            offsets = pa.array(ends, pa.int32())
            return {"conv_id": batch.column("conv_id"), "n_turns": n, "input_ids": pa.ListArray.from_arrays(offsets, pa.array(ids)), "loss_mask": pa.ListArray.from_arrays(offsets, pa.array(mask))}

        return rows

    return map_rows(ordered_turns(convs), FORMATTED, make)


def turns_of(ids: np.ndarray, decode, first_free: int, template: Template) -> Iterator[tuple[str, str]]:
    """Escaped roles and texts between the reserved ids."""
    opens, bodies, closes = (np.flatnonzero(ids == first_free + k) for k in range(3))
    for o, b, c in zip(opens, bodies, closes, strict=True):
        yield decode(ids[o + 1 : b].tolist()), decode(ids[b + 1 : c].tolist())


def learned_texts(ids: np.ndarray, mask: np.ndarray, decode, first_free: int) -> Iterator[str]:
    """The escaped texts under the mask, one for each run of it; reserved ids are no text."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        run = ids[a:b]
        yield decode(run[run < first_free].tolist())


def rendered(ids: np.ndarray, decode, first_free: int, template: Template) -> str:
    """The formatted text of ids, control strings included."""
    return "".join(f"{template.open}{role}{template.body}{text}{template.close}" for role, text in turns_of(ids, decode, first_free, template))


def read_back(formatted: DataFrame, template: Template | None = None, vocabulary: str | None = None) -> DataFrame:
    """``DIGESTS`` of what ids and mask hold, by decoding and unescaping them."""
    template = template or Template()

    def make():
        tokens = _tokens.byte_bpe(vocabulary)

        def rows(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in DIGESTS}
            out["conv_id"] = batch.column("conv_id")
            lists, masks = batch.column("input_ids"), batch.column("loss_mask")
            for k in range(batch.num_rows):
                ids, mask = lists[k].values.to_numpy(), masks[k].values.to_numpy()
                digest, n, chars = hashlib.sha256(), 0, 0
                for role, text in turns_of(ids, tokens.decode, tokens.size, template):
                    n, chars = n + 1, chars + len(role) + len(text)
                    digest.update(f"{template.unescape(role, True)}\n{template.unescape(text)}\n".encode())
                learned = "".join(template.unescape(t) for t in learned_texts(ids, mask, tokens.decode, tokens.size))
                out["n_turns"].append(n)
                out["turns_sha256"].append(digest.hexdigest())
                out["loss_chars"].append(len(learned))
                out["loss_sha256"].append(hashlib.sha256(learned.encode()).hexdigest())
                out["formatted_chars"].append(chars + n * len(template.open + template.body + template.close))
            return out

        return rows

    return map_rows(formatted, DIGESTS, make)


def with_tricky(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """The conversations and ``TRICKY_ID``, whose user and assistant both say ``TRICKY``."""
    table = convs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return table.unionByName(spark.createDataFrame([(TRICKY_ID, k, role, TRICKY) for k, role in enumerate(("user", "assistant"))], table.schema))


#: Digests of the turns by SQL, and the template's characters counted by its rules.
DIGEST_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '#(\\*)## ', '#\\\1## ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g')) AS text_chars,
 length(regexp_replace(regexp_replace(regexp_replace(role, '#(\\*)## ', '#\\\1## ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g'), ':(\\*)\n', ':\\\1' || chr(10), 'g')) AS role_chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
 coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(13 + role_chars + text_chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
