"""The corpus operators on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing columns, and brute force."""

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from crosswind.llm import edit_fingerprint, entries, html_text, lang_mix, license_scan, mixing, near_dup, packing, quality_qda, rule_lists, url_cascade

WORDS = "the of and to alpha beta gamma delta river stone light cloud water green field house north south winter summer".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "ly"]) for _ in range(n))


TEXTS = [
    None, "", " \n\t ", "word", "That it.", prose(1, 40), prose(1, 40), prose(1, 40) + " more", prose(2, 400), "é" * 9000, "All rights reserved.", prose(3, 30) + " Licensed under CC BY-NC 4.0.\n" + prose(4, 30),
    "### $$$ %%% " * 30, "same same same same same same same same same same same same", "line one here\nline one here\n\nline one here", "\U0001f600 \U0001f600", "Γειά σου Κόσμε Σ", prose(5, 3000),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, n_words int, row int, words string, key string, token string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns bear names that operators use inside; one row is repeated, one id is null nowhere."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "src0", "src1"][i % 3], None, 7, 7, "x", "y", "z", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 1, 0), (8, 1, 0), (12, 0, 0), (13, 0, 0), (5, 1, 0), (99, 1, 0), (7, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")


def test_packing(spark, docs, none):
    got = packing.pack(spark, docs, per_partition=5).toPandas()
    bins = got.sort_values(["sequence_id", "offset"])
    assert ((bins.groupby("sequence_id").length.cumsum() - bins.length) == bins.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert got.sequence_id.nunique() == packing.lower_bound(got.length.to_numpy())
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(TEXTS):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].drop_duplicates(["piece"]).sort_values("piece")
        want = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert mine.length.tolist() == [len(w) for w in want]
        assert mine.ids_crc32.tolist() == [zlib.crc32(struct.pack(f"<{len(w)}I", *w)) for w in want]
    assert packing.pack(spark, none).count() == 0


def test_packing_of_special_tokens_and_null_ids(spark):
    got = packing.pack(spark, spark.createDataFrame([(None, "hello <|endoftext|> world"), (None, None), (3, "<|startoftext|>")], "doc_id long, text string")).toPandas()
    want = [[3306, 49407, 1002, 0], [0], [49406, 0]]
    assert sorted(zip(got.length, got.ids_crc32)) == sorted((len(w), zlib.crc32(struct.pack(f"<{len(w)}I", *w))) for w in want)


def test_packing_never_gathers_what_certifies_nothing(spark, monkeypatch):
    """Pieces of three lengths that leave every bin with room: rounds end, and no task holds all pieces."""
    lengths = [600, 450, 300] * 700
    pieces = spark.createDataFrame([(i, 0, 0, n, i, i) for i, n in enumerate(lengths)], packing.PIECES)
    monkeypatch.setattr(packing, "cut", lambda *_: pieces)
    held = []
    real = packing.place
    monkeypatch.setattr(packing, "place", lambda p, parts, *a: held.append((p.count(), parts)) or real(p, parts, *a))
    got = packing.pack(spark, pieces, per_partition=100).toPandas()
    assert all(n <= packing.FAN_IN * 100 * parts for n, parts in held) and held[-1][1] > 1 and len(held) <= packing.MOST_ROUNDS + 1
    assert len(got) == len(lengths) and got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert got.sequence_id.nunique() <= 1.1 * packing.lower_bound(np.array(lengths))


def test_best_fit_and_bounds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        bins, offsets, n = packing.best_fit_decreasing(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and n >= packing.lower_bound(sizes, 100)
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3
    assert packing.lower_bound(np.array([], int)) == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div>
<div id=content><h1>Title &amp; more</h1><p>First  paragraph with <b>some</b> words that are long enough to count.</p><p>Short.<div class=ad>Buy now</div><p>Second one&nbsp;here, again with rather many words.</div>
<aside>Related</aside><div class="comments"><p>Nice article, I liked it very much indeed, thanks for writing it down.</p></div><form><p>Sign up</p></form><footer>&copy; me</footer>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with some words that are long enough to count.\nShort.\nSecond one here, again with rather many words."
    assert html_text.main_text(None) == "" == html_text.main_text("<nav>x</nav>")
    assert html_text.main_text("<article><h1>A</h1><p>b<br>c</article><p>after") == "A\nb c"
    assert html_text.main_text("<div class=top-header><h1>Site</h1></div><div><h1>A</h1><div><p>Some words that make up the text of this page.</div></div>") == "A\nSome words that make up the text of this page."
    pages = spark.createDataFrame([(1, "u", None, "q"), (2, None, PAGE, "q"), (2, None, PAGE, "q"), (3, "u", "", "q")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).toPandas()
    assert sorted(got.n_chars) == [0, 0, len(html_text.main_text(PAGE)), len(html_text.main_text(PAGE))]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    got = license_scan.scan(spark, docs).toPandas()
    assert len(got) == len(TEXTS) + 1
    one = got.set_index("doc_id").loc
    assert one[10, "base_labels"] == "reserved" and one[10, "first_word"] == 0 == one[10, "last_word"] and one[10, "labels"] == "reserved"
    assert one[11, "labels"] == "cc-by,cc-by-nc-4.0" and one[11, "n_base"] == 1 and one[11, "score"] == 1.0
    assert np.isnan(one[0, "first_word"]) and one[0, "n_words"] == 0 and one[0, "labels"] == ""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for i, t in enumerate(TEXTS):
        if i != 5:
            assert one[i, "n_words"] == len(pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))
    assert license_scan.scan(spark, none).count() == 0


def brute_spans(text: str, gram: int = 3) -> dict:
    """Best covered part of each template by plain loops over all pairs of positions."""
    out, words = {}, license_scan.words_of(text)
    for t, (_, statement) in enumerate(license_scan.TEMPLATES):
        want = statement.encode().split()
        at = sorted((i - p, i, p) for p in range(len(want) - gram + 1) for i in range(len(words) - gram + 1) if words[i : i + gram] == want[p : p + gram])
        by = {}
        for d, i, p in at:
            by.setdefault(d, []).append((i, p))
        best, span, last = 0.0, set(), None
        for d in sorted(by):
            first = min(i for i, _ in by[d])
            if last is None or d - last[0] > license_scan.NEIGHBOURS or first - last[1] > len(want):
                span = set()
            span |= {p + k for _, p in by[d] for k in range(gram)}
            last, best = (d, max(i for i, _ in by[d])), max(best, len(span) / len(want))
        out[t] = min(best, 1.0)
    return out


def test_licenses_as_by_brute_force(spark):
    """Whole notices, some with words put in, left out or changed, among other words."""
    rng, rows = random.Random(8), []
    for i, (_, statement) in enumerate(license_scan.TEMPLATES * 2):
        words = statement.split()
        for _ in range(rng.randint(0, max(1, len(words) // 8))):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [words[at], "indeed"], ["other"]])
        rows.append((i, prose(i, 20) + ". " + " ".join(words).upper() + "; " + prose(i + 1, 20)))
    got = license_scan.scan(spark, spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    for i, text in rows:
        parts = brute_spans(text)
        base = got.base_labels[i].split(",") if got.base_labels[i] else []
        want = sorted({*base, *(license_scan.TEMPLATES[t][0] for t, v in parts.items() if v >= license_scan.COVERED)})
        assert got.labels[i] == ",".join(want)
        assert abs(got.score[i] - max(*parts.values(), 0.5 * bool(base))) < 1e-12


def brute_components(texts: dict, k: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = dict(enumerate(TEXTS))
    rng = random.Random(3)
    for i in range(100, 160):  # copies of a text with edits, near each other through the text or in chains
        words = prose(9, 120).split()
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(words)
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for k in (2, 5):
        got = near_dup.find(spark, table, near_dup.Settings(k, 80)).toPandas().set_index("doc_id")
        want = brute_components(texts, k, 80)
        assert {i: int(c) for i, c in got.component_id.items()} == want
        assert (got.kept == (got.index == got.component_id)).all()
    assert near_dup.find(spark, none).count() == 0
    assert near_dup.deduplicated(spark, docs).columns == docs.columns
    assert near_dup.deduplicated(spark, docs).count() == len(set(brute_components(dict(enumerate(TEXTS)), 5, 80).values()))


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 50), (60, 30)]
    got = near_dup.components(spark, spark.createDataFrame(links, "a long, b long")).toPandas()
    assert dict(zip(got.node, got.root)) == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 50: 30, 60: 30}


def test_quality(spark, docs, none, labels):
    got = quality_qda.classify(spark, docs, labels).toPandas()
    assert len(got) == len(TEXTS) + 1 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert quality_qda.classify(spark, none, labels).count() == 0
    assert set(quality_qda.classify(spark, docs, labels.limit(0)).toPandas().score) == {0.5}
    assert quality_qda.filtered(spark, docs, labels).columns == docs.columns


def test_discriminant_holds_out_well():
    good = np.array([quality_qda.statistics(prose(i, 20 + i % 200)) for i in range(300)])
    bad = np.array([quality_qda.statistics(" ".join(w + "###" for w in prose(i, 20 + i % 200).split())) for i in range(300)])
    x, y = np.vstack([good, bad]), np.repeat([1, 0], 300)
    fit = [np.array([x[:, :][(y == c) & (np.arange(600) % 2 == 0)].sum(axis=0) for c in (0, 1)]), np.array([(x[(y == c) & (np.arange(600) % 2 == 0)].T @ x[(y == c) & (np.arange(600) % 2 == 0)]) for c in (0, 1)])]
    model = quality_qda.model_of(np.array([150.0, 150.0]), *fit)
    held = np.arange(600) % 2 == 1
    assert ((model.score(x[held]) >= 0.3) == y[held]).mean() > 0.99


def test_mixing(spark, docs, none):
    got = mixing.decide(spark, docs).toPandas()
    assert len(got) == len(TEXTS) + 1 and got.probability.between(0, 1).all()
    assert got[got.tokens == 0].kept.all()
    assert mixing.decide(spark, none).count() == 0
    kept = mixing.sample(spark, docs.withColumn("_key", docs.row))
    assert kept.columns == [*docs.columns, "_key"] and kept.count() == got.kept.sum()
    # calibrated: a cell's expected tokens are its raked weight, so that expected shares meet the tempered goals
    told = got[got.tokens > 0]
    mass = (told.tokens * told.probability).groupby(told.source.fillna("none")).sum()
    share = told.tokens.groupby(told.source.fillna("none")).sum() ** mixing.TEMPER
    assert abs(mass / mass.sum() - share / share.sum()).max() < 0.05
    kept = mixing.sample(spark, docs)
    assert kept.columns == docs.columns and kept.count() == got.kept.sum()


def test_raking_meets_targets():
    rng = np.random.default_rng(5)
    mass = rng.random((4, 3, 2)) + 0.5
    share = mass / mass.sum()
    goal = [mixing.goals(list("abcd"), mass.sum(axis=(1, 2)), {"a": 0.3}), mixing.goals(list("xyz"), mass.sum(axis=(0, 2)), None), mixing.goals([0, 1], mass.sum(axis=(0, 1)), None)]
    out, error = mixing.rake(mass, goal)
    assert error < 1e-8 and abs(out.sum() - 1) < 1e-8
    # raked weights keep the table's own odds ratios
    odds = lambda m: m[0, 0, 0] * m[1, 1, 0] / (m[0, 1, 0] * m[1, 0, 0])
    assert abs(odds(out) / odds(share) - 1) < 1e-6
    assert abs(out.sum(axis=(1, 2)) - goal[0]).max() < 1e-8


def test_fingerprints(spark, docs, none):
    got = edit_fingerprint.fingerprint_with_edit(spark, docs, parts=3).toPandas().sort_values("doc_id", kind="stable").drop_duplicates("doc_id").reset_index(drop=True)
    order = [*range(len(TEXTS))]
    for i in order:
        own, follow = TEXTS[i] or "", TEXTS[5 if i == 5 else (i + 1) % len(TEXTS)] or ""
        n = len(own) // 4
        import hashlib

        want = {hashlib.sha256(((own[: len(own) - n] + f[:n]) if n else own).encode()).hexdigest() for f in (follow, TEXTS[(i + 1) % len(TEXTS)] or "")}
        assert got.edited_sha256[i] in want and got.n_chars[i] == len(own)
    assert got.fingerprint[5] == got.fingerprint[6] and got.fingerprint[0] == got.fingerprint[1]
    assert edit_fingerprint.fingerprint_with_edit(spark, none).count() == 0
    prints = got[["doc_id", "fingerprint"]]
    pairs = edit_fingerprint.near_pairs(spark.createDataFrame(prints)).toPandas()
    assert (pairs.near >= 0.6).all()


def test_fingerprints_follow_edits():
    walker, text = edit_fingerprint.Walker(), prose(1, 500)
    half = text[:1000] + "#" + text[1000:]
    a, b, c = walker.fingerprints([text, half, prose(7, 500)])
    assert edit_fingerprint.likeness(a[None], b[None])[0] > 0.5 > edit_fingerprint.likeness(a[None], c[None])[0] + 0.3


def test_rules(spark, docs, none, labels):
    got = rule_lists.apply(spark, docs, labels).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    word = re.compile("[^\x20\x09-\x0d]+")
    for i, t in enumerate(TEXTS):
        w, lines = word.findall(t or ""), [x for x in (t or "").split("\n") if word.search(x)]
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        assert tuple(got.loc[i, list(rule_lists.BASE)]) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert got.loc[i, "base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert not (got.base_failed & got.kept).any()
    assert rule_lists.apply(spark, none, labels).count() == 0
    assert rule_lists.filtered(spark, docs, []).columns == docs.columns


def test_learned_lists():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.5) | (x[:, 2] > 0.95)
    rules = rule_lists.learn(x, bad)
    found = np.zeros(len(x), bool)
    for r in rules:
        found |= rule_lists.covers(r, x)
    assert rules and (found & ~bad).sum() <= 20 and (found & bad).sum() > 0.9 * bad.sum()
    assert rule_lists.learn(x, np.zeros(2000, bool)) == [] == rule_lists.learn(x[:0], bad[:0])


def test_languages(spark, docs, none):
    got = lang_mix.identify(spark, docs).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert (got.lang_pred[[0, 1, 2, 15]] == "und").all() and got.score.between(0, 1).all()
    assert lang_mix.identify(spark, none).count() == 0
    assert set(lang_mix.identify(spark, docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None)).toPandas().lang_pred) == {"und"}


def test_languages_by_expectation_maximisation():
    """Proportions of a two-language text, and answers on held-out sentences."""
    rng = np.random.default_rng(4)
    words = {"xx": ["aba", "bab", "abba", "baba"], "yy": ["ono", "non", "onno", "nono"], "zz": ["kili", "liki", "ilik", "kiki"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    names, counts = tuple(words), []
    for lang in names:
        counts.append(np.bincount(lang_mix.cells(say(lang, 400)), minlength=lang_mix.CELLS) + lang_mix.SMOOTH)
    logs = np.log(np.array(counts) / np.array(counts).sum(axis=1, keepdims=True)).T.astype(np.float32)
    model = lang_mix.Model(names, logs, np.full(3, 1 / 3))
    for lang in names:
        assert model.judge(say(lang, 20))[0] == lang and model.judge(say(lang, 20))[1] > 0.9
    chosen, parts = model.mixture(lang_mix.cells(say("xx", 60) + " " + say("zz", 140)))
    assert [names[c] for c in chosen] == ["zz", "xx"] and abs(parts[0] - 0.7) < 0.08
    assert model.judge(say("xx", 60) + " " + say("zz", 140))[0] == "zz"


def test_urls(spark):
    urls = [None, "", "nothing", "http://net/", "http://net", "https://A.Example.NET/en/x?q", "http://x.example.com/de/1", "http://b.org/fr/#a", "http://casino-win.example.org/en", "HTTP://www.casino-win.example.org?x", "http://notcasino-win.example.org/", "x://h:80/p//://q"]
    pages = spark.createDataFrame([(i, u, "a") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    got = url_cascade.judge(spark, pages).toPandas().drop_duplicates().set_index("page_id")
    assert got.rule.where(got.rule.notna(), None).tolist() == [None, None, None, "net/", None, "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert got.verdict.tolist() == ["allow"] * 3 + ["block", "allow", "allow", "block", "allow", "block", "block", "allow", "allow"]
    assert got.host[5] == "a.example.net" and got.path[5] == "/en/x" and got.host[11] == "h:80" and got.path[11] == "/p//://q"
    assert url_cascade.judge(spark, pages.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    keys, listed = [f"k{i}" for i in range(3000)], [f"k{i}" for i in range(0, 3000, 37)]
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    levels = url_cascade.build(table, spark.createDataFrame([(k,) for k in listed], "key string"))
    got = {r["key"] for r in table.where(url_cascade.contains(table.key, levels)).collect()}
    assert got == set(listed)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 14))
