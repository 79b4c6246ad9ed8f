"""The trie of conversations, chat formatting and token alignment: against brute force and exact round trips."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crosswind.llm import _tokens, chat_format, entries, token_align, turn_trie

SMALL = "/root/testdata/sf0.001"
CONVS = "conv_id long, turn long, role string, text string"


def rows_of(frame):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


def sql(query, sf_dir=SMALL):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    return con.execute(query).df()


# --- conversation prefix trie


def brute_trie(rows):
    """Nodes by dictionaries of prefixes."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1] or 0, y[2], hashlib.md5(f"{len(y[2].encode())} {y[2]}{y[3]}".encode()).hexdigest()))] for c, x in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + turns[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, w in whole.items():
        ends[w].append(c)
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(children[x] == 0 for x in below), saved, hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows, shard_turns=10**6):
    got = turn_trie.trie(spark, spark.createDataFrame(rows, CONVS), shard_turns).collect()
    return sorted((tuple(r[c] for c in turn_trie.NODES.names) for r in got), key=repr)


def shared_openings(seed, n):
    """Few different turns, so that sequences share much; copies, one long conversation, ids with gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(0, 3 * n, 1 + seed % 2):
        if rng.random() < 0.6:
            long = 45 if c == 10 else int(rng.integers(1, 12))
            rows += [(c, k, ("user", "assistant")[k % 2], "ab"[int(rng.random() < 0.25)] * (1 + k % 3)) for k in range(long)]
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 10**6), (2, 60), (3, 25), (4, 9)])
def test_trie_equals_brute_force(spark, seed, shard):
    rows = shared_openings(seed, 40)
    assert trie_rows(spark, rows, shard) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    """Nulls in every column, empty texts, ties and repeated rows, ids absent or negative, a very long text and many equal conversations."""
    rows = [
        (0, None, "user", "first"), (0, 0, None, None), (0, 0, "", ""), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "assistant", "x"), (None, 0, "user", "none"), (3, None, None, None),
        (-7, 0, "user", "a"), (-7, 1, "user", "b"), (-5, 0, "user", "c"), (12, 0, "us", "er"), (13, 0, "u", "ser"), (21, 5, "user", "é" * 300_000), *[(1000 + 5 * k, 0, "user", "same") for k in range(200)],
    ]
    assert trie_rows(spark, rows) == trie_rows(spark, rows, 5) == brute_trie(rows)
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_trie_query_equals_sql(spark):
    want = sql(turn_trie.TRIE_SQL)
    got = entries.queries()["op11_turn_trie"](spark, SMALL).toPandas()
    assert rows_of(got.astype({"parent_conv_id": "float"})) == rows_of(want.astype({"parent_conv_id": "float"}))


def test_trie_ignores_other_columns(spark):
    rows = shared_openings(5, 20)
    table = spark.createDataFrame([(*r, 1, "x", 2.0, None) for r in rows], CONVS + ", family long, ids string, `a.b` double, `shard` int")
    got = turn_trie.trie(spark, table).collect()
    assert sorted((tuple(r[c] for c in turn_trie.NODES.names) for r in got), key=repr) == brute_trie(rows)


# --- chat formatting


def test_chat_query_equals_sql(spark):
    got = entries.queries()["op12_chat_format"](spark, SMALL).toPandas()
    assert rows_of(got) == rows_of(sql(chat_format.DIGEST_SQL)) and -7 in set(got.conv_id)


TEMPLATES = [chat_format.Template(), chat_format.Template("<|im_start|>", "\n\n>", "<|im_end|>", ("assistant", "tool"), True)]
BITS = st.lists(st.sampled_from(["### ", "###", "#", " ", "</turn>", "</", "turn>", "<\\/turn>", "\\", "\\\\", ":\n", ":", "\n", "##\\# ", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "é", " ", "x" * 5, "🙂", "\0"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(BITS, st.sampled_from(["user", "assistant"])), BITS), max_size=5), st.sampled_from(TEMPLATES))
def test_format_round_trip(turns, template):
    """Roles and texts come back from ids and from the rendered text, learned texts from the mask, whatever they hold."""
    tokens = _tokens.byte_bpe()
    ids, mask, length = chat_format.assemble(tokens.encode, tokens.size, [r for r, _ in turns], [t for _, t in turns], template)
    assert length.sum() == len(ids) == len(mask) and (mask <= 1).all()
    back = [(template.unescape(r, True), template.unescape(t)) for r, t in chat_format.turns_of(ids, tokens.decode, tokens.size, template)]
    assert back == turns == template.parse(chat_format.rendered(ids, tokens.decode, tokens.size, template))
    learned = "".join(template.unescape(t) for t in chat_format.learned_texts(ids, mask, tokens.decode, tokens.size))
    assert learned == "".join(t for r, t in turns if r in template.learned)
    for _, text in turns:  # no control string that a text is ended by stays in it
        assert template.close not in template.escape(text) and template.open not in template.escape(text)


def test_overlapping_control_strings_are_refused():
    for bad in (("aa", "bc", "de"), ("ab", "bc", "de"), ("ab", "xaby", "de"), ("a\\", "bc", "de"), ("a", "bc", "de")):
        with pytest.raises(ValueError):
            chat_format.Template(*bad)


def test_formatting_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, None, "user", "a"), (1, 2, "assistant", "b"), (1, 3, None, None), (None, 1, "user", "x"), (2, 1, "assistant", None), (3, 1, "assistant", "long ### " * 60_000), (4, 1, "assistant", " " * 50_000 + "x")]
    table = spark.createDataFrame([(*r, "y", 1) for r in rows], CONVS + ", input_ids string, `loss.mask` int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\nassistant\nb\n\n\n") and got[1].loss_sha256 == sha("bb") and got[1].loss_chars == 2 and got[1].n_turns == 4
    assert got[None].loss_chars == 0 and got[2].loss_sha256 == sha("") and got[2].n_turns == 1
    assert got[3].loss_sha256 == sha("long ### " * 60_000) and got[3].formatted_chars == 10 * 60_000 + 13 + len("assistant") and got[4].loss_chars == 50_001
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], CONVS))).count() == 0


# --- cross-tokenizer alignment


def brute_alignment(docs):
    """Merges token by token with a pointer on each side; all links as pairs."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    in_a, in_b = _tokens.byte_bpe().bytes_of, _tokens.pieces().bytes_of
    every, count = [], collections.Counter()
    for doc_id, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if text and not b"".join(in_a[i] for i in ids_a) == b"".join(in_b[i] for i in ids_b) == (" " + text).encode():
            ids_a, ids_b = [], []
        groups, links, at, to = [], collections.Counter(), [0, 0], [0, 0]
        now = ([], [])
        while at[0] < len(ids_a) or at[1] < len(ids_b):
            side = 0 if to[0] <= to[1] else 1
            token = (ids_a, ids_b)[side][at[side]]
            now[side].append(token)
            at[side] += 1
            to[side] += len((in_a, in_b)[side][token])
            if to[0] == to[1]:
                groups.append(now)
                now = ([], [])
        for ga, gb in groups:
            links.update((x, y) for x in ga for y in gb)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        every.append((doc_id, len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest() if said else "", links))
        count.update(links.keys())
    most = {}
    for (x, _), n in count.items():
        most[x] = max(n, most.get(x, 0))
    return sorted((*d[:5], sum(n for (x, y), n in d[6].items() if count[x, y] == most[x]), sum(n * count[k] for k, n in d[6].items()), d[5]) for d in every)


def aligned_rows(spark, docs):
    return sorted(tuple(r) for r in token_align.align(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect())


def texts(seed=6, n=60):
    rng = np.random.default_rng(seed)
    words = ["the", "Straße", "naïve", "日本語", "don't", "<|endoftext|>", "<0x41>", "▁", "ﬁ", "Á", "1234567", "🙂🙂", "\t", "\n\n", "  ", "aaaaaaaaaaaa", "-----", "</s>", "Ünïcödé", "\xa0"]
    return ["".join(str(rng.choice(words)) + " " * int(rng.integers(0, 2)) for _ in range(int(rng.integers(1, 25)))) for _ in range(n)]


def test_alignment_equals_brute_force(spark, monkeypatch):
    docs = [*enumerate(texts()), (100, None), (101, ""), (102, "▁"), (103, "same text"), (104, "same text"), (105, "x" * 3000 + "é" * 1500), (106, " " * 6000 + "end")]
    want = brute_alignment(docs)
    assert aligned_rows(spark, docs) == want
    assert len({w[0] for w in want if w[1] == 0}) >= 3


def test_alignment_in_small_chunks(monkeypatch):
    """Wide groups reduced to counts, links in chunks and short batches give what one batch gives."""
    aligner = token_align.Aligner(_tokens.byte_bpe(), _tokens.pieces())
    some = [*texts(7, 40), "x" * 2000 + "́" * 900, ""]
    want, *links = aligner.align(some)
    monkeypatch.setattr(token_align, "WIDE", 2)
    monkeypatch.setattr(token_align, "CHUNK_LINKS", 50)
    got, *again = aligner.align(some)
    assert all(np.array_equal(x, y) for x, y in zip(links, again)) and all(list(got[k]) == list(want[k]) for k in want)


def test_alignment_of_odd_rows(spark):
    rows = [(None, "a b", 1, "z"), (None, "a b", 1, "z"), (5, "a b", 1, None), (5, None, 2, "q")]
    got = token_align.align(spark, spark.createDataFrame(rows, "doc_id long, text string, block int, `a.b` string")).collect()
    assert len(got) == 4 and {(r.doc_id, r.n_a > 0) for r in got} == {(None, True), (5, True), (5, False)} and max(r.count_sum for r in got) == 3 * got[[r.n_a > 0 for r in got].index(True)].n_links
    assert token_align.align(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_byte_ids_equal_the_plain_tokenizer():
    tokens = _tokens.byte_bpe()
    rng = np.random.default_rng(11)
    alphabet = [*"aZ09'tsl ÄéßŒ日本🙂́ \xa0\t\n\r\x1c½١-_#", "<|endoftext|>", "  ", "'ll"]
    some = ["".join(rng.choice(alphabet) for _ in range(int(rng.integers(0, 60)))) for _ in range(3000)] + [" " * 2500 + "a", "\n" * 3000]
    assert tokens.fast is not None
    for text in some:
        assert tokens.encode(text).tolist() == tokens.plain.encode(text, add_special_tokens=False).ids and tokens.decode(tokens.encode(text).tolist()) == text
