"""Whole results against plain Python: decisions, held-out accuracy, recall and the pipeline's rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosswind.llm import edit_fingerprint, lang_mix, license_scan, mixing, near_dup, packing, quality_qda, rule_lists
from test_ops import brute_components

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{MORE}/documents.parquet")


def fold(ids, by):
    return np.array([zlib.crc32(str(i).encode()) % by for i in ids])


def test_quality_on_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    got = quality_qda.classify(spark, documents, labels).toPandas()
    rows, marks = documents.select("doc_id", "text").toPandas(), labels.toPandas()
    # the discriminant by its definition: class moments in NumPy, log densities by explicit inverses
    x = np.array([quality_qda.statistics(t or "") for t in rows.text])
    at = {d: i for i, d in enumerate(rows.doc_id)}
    known = [(at[d], q) for d, q in zip(marks.doc_id, marks.quality) if d in at and q in (0, 1)]
    i, y = np.array([k[0] for k in known]), np.array([int(k[1]) for k in known])
    train = fold(rows.doc_id.to_numpy()[i], 5) != 0
    a = [x[i[train & (y == c)]] for c in (0, 1)]
    n = np.array([len(v) for v in a], float)
    covs = [np.cov(v, rowvar=False, bias=True) for v in a]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    scale = np.sqrt(np.diag(pooled)) + 1e-3
    logs = []
    for c in range(2):
        unit = ((1 - quality_qda.TO_POOLED) * covs[c] + quality_qda.TO_POOLED * pooled) / np.outer(scale, scale)
        unit = (1 - quality_qda.TO_IDENTITY) * unit + quality_qda.TO_IDENTITY * max(np.trace(unit) / len(unit), 1e-3) * np.eye(len(unit))
        cov, off = unit * np.outer(scale, scale), x - a[c].mean(axis=0)
        logs.append(np.log(n[c] / n.sum()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    mine = got.set_index("doc_id").score[rows.doc_id].to_numpy()
    assert np.abs(mine - want).max() < 1e-5
    held = ~train
    assert ((mine[i[held]] >= 0.3) == y[held]).mean() > 0.97


def test_languages_on_the_held_out_fold(spark, documents):
    got = lang_mix.identify(spark, documents).toPandas().set_index("doc_id")
    rows = documents.where("lang is not null and text is not null").select("doc_id", "lang").toPandas()
    rows = rows[fold(rows.doc_id, 4) == 2]
    mine = got.loc[rows.doc_id]
    assert mine.held_out.all() and (mine.lang_pred.to_numpy() == rows.lang.to_numpy())[mine.lang_pred != "und"].mean() > 0.98


def test_rule_verdicts(spark):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    rules = rule_lists.learned(spark, docs, labels)
    stats = rule_lists.statistics(docs, "doc_id").select("doc_id", *rule_lists.BASE, *[v.alias(k) for k, v in rule_lists.shares().items()]).toPandas().set_index("doc_id")
    x = stats[list(rule_lists.shares())].to_numpy(float)
    bad = (stats.n_words < 10) | (100 * stats.n_repeat_words > 20 * stats.n_words)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= rule_lists.covers(r, x)
    got = rule_lists.apply(spark, docs, labels).toPandas().set_index("doc_id").loc[stats.index]
    assert rules and (got.kept.to_numpy() == ~(bad.to_numpy() | hit)).all()


def test_mixing_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.decide(spark, docs).toPandas()
    cells = got.assign(source=got.source.fillna("-"), lang=got.lang.fillna("-")).groupby(["source", "lang", "topic"]).tokens.sum().reset_index()
    chance = mixing.probabilities([tuple(r) for r in cells.itertuples(index=False)])
    want = [chance[(s or "-", g or "-", t)] if n else 1.0 for s, g, t, n in zip(got.source, got.lang, got.topic, got.tokens)]
    assert np.abs(got.probability - want).max() < 1e-9
    assert got.tokens[got.kept].sum() > 0.4 * got.tokens.sum() and got.kept[got.probability == 1.0].all()
    words = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).toPandas().set_index("doc_id").t
    assert all(len(words[d].encode().split()) == n for d, n in zip(got.doc_id, got.tokens))


def test_fingerprint_bands_meet_near_texts(spark):
    """Of text and edited-text pairs at the threshold or nearer, nine of ten at least share a band."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r["text"] or "" for r in rows]
    walker = edit_fingerprint.Walker()
    a = walker.fingerprints(texts)
    b = walker.fingerprints([edit_fingerprint.edited(t, f) for t, f in zip(texts, [*texts[1:], texts[0]])])
    near = edit_fingerprint.likeness(a, b) >= edit_fingerprint.LEAST
    met = np.zeros(len(a), bool)
    for at in edit_fingerprint._sampled(edit_fingerprint.SLOTS, edit_fingerprint.BAND):
        met |= (a[:, at] == b[:, at]).all(axis=1)
    assert near.sum() > 100 and met[near].mean() >= 0.9
    # the end of a text counts: a change of its last fifth changes about a fifth of the slots
    long = [t for t in texts if len(t) > 400]
    changed = walker.fingerprints([t[: -(len(t) // 5)] + "#" * (len(t) // 5) for t in long])
    assert 0.15 < 1 - edit_fingerprint.likeness(walker.fingerprints(long), changed).mean() < 0.3


def test_license_base_columns(spark, documents):
    got = license_scan.scan(spark, documents).toPandas().set_index("doc_id")
    for r in documents.collect():
        words = license_scan.words_of(r["text"] or "")
        at = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()] for p, label in license_scan.BASE}
        every = sorted(i for v in at.values() for i in v)
        row = got.loc[r["doc_id"]]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(every), ",".join(sorted(k for k, v in at.items() if v)))
        assert (row.first_word, row.last_word) == (every[0], every[-1]) if every else np.isnan(row.first_word)


def test_pipeline_rows(spark):
    """Each stage's rows by plain Python on the rows of the stage before."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, at = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stored(spark, stage(spark, docs, SMALL), "brute")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert all(after[i] == before[i] for i in after) and docs.count() == len(after)
        at[name] = (before, after)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = quality_qda.classify(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), labels).toPandas()
    assert set(at["quality classifier"][1]) == set(scores.doc_id[scores.predicted == 1])
    verdicts = rule_lists.apply(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), labels).toPandas()
    assert set(at["quality rules"][1]) == set(verdicts.doc_id[verdicts.kept]) & set(at["quality rules"][0])
    before, after = at["near duplicates"]
    assert set(after) == set(brute_components({i: r["text"] for i, r in before.items()}, 5, 80).values())
    before, after = at["target mix"]
    tokens = lambda rows: sum(len((r["text"] or "").split()) for r in rows.values())
    assert 0.4 * tokens(before) < tokens(after) < tokens(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas().sort_values(["doc_id", "piece"])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in after.items():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        mine = packed[packed.doc_id == i]
        assert mine.ids_crc32.tolist() == [zlib.crc32(struct.pack(f"<{len(w)}I", *w)) for w in want]
    full = packed.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and len(full) <= 1.02 * packing.lower_bound(packed.length.to_numpy()) + 1


def test_near_duplicate_recall(spark, documents):
    """Every link of all pairs with a rare shingle in common, at both widths, is inside a component."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for words in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in near_dup.find(spark, documents, near_dup.Settings(words, 80)).collect()}
        assert got == brute_components(texts, words, 80)
