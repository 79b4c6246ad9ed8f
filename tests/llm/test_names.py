"""Column names of any kind through all stages, many languages, and walks that don't depend on their neighbours."""

import numpy as np

import corpus_pipeline
from crosswind.llm import edit_fingerprint, lang_mix

SMALL = "/root/testdata/sf0.001"


def test_stages_with_awkward_names(spark):
    """Dotted, quoted, upper-case and clashing names come back as they were, and decisions don't change."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = ["a.b", "say `it`", "TEXT", "Doc_ID", "n", "kept", "row", "key", "_column1", "é x"]
    more = docs.select("*", *[docs["doc_id"].alias(f"x{i}") for i in range(len(odd))])
    awkward = more.toDF(*docs.columns, *odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, SMALL), stage(spark, awkward, SMALL)
        assert got.columns == [*docs.columns, *odd]
        ids = sorted(r[0] for r in plain.toDF(*[f"c{i}" for i in range(len(plain.columns))]).select(f"c{docs.columns.index('doc_id')}").collect())
        rows = got.toDF(*[f"c{i}" for i in range(len(got.columns))]).collect()
        at = docs.columns.index("doc_id")
        assert sorted(r[at] for r in rows) == ids and all(r[at] == r[len(docs.columns)] for r in rows)


def test_all_languages_are_learned(spark):
    """More languages than a dense table takes: each with letters of its own; and sparse rows equal dense ones."""
    rows, letters = [], "abcdefghijklmnopqrstuvwxyz"
    for k in range(300):
        word = letters[k % 26] + letters[k // 26] + letters[(7 * k) % 26]
        rows += [(3 * k + j, f"{word} " * 12, f"l{k:03d}") for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_mix.fit(docs)
    assert len(model.languages) == 300 and isinstance(model.logs, lang_mix.Sparse)
    assert np.mean([model.judge(t)[0] == g for _, t, g in rows]) > 0.98
    rng = np.random.default_rng(1)
    at = np.unique(rng.integers(0, lang_mix.CELLS * 5, 400))
    cell, lang, n = at // 5, at % 5, rng.integers(1, 9, len(at)).astype(float)
    some = rng.integers(0, lang_mix.CELLS, 50)
    some[:20] = cell[:20]
    assert np.array_equal(lang_mix.logs_of(cell, lang, n, 5)[some], lang_mix.logs_of(cell, lang, n, 5, dense=1)[some])


def test_a_walk_alone_is_a_walk_in_company():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(65, 90, 40)] + ["a" * 70, "b" * 90, "x", "", "ab" * 5]
    walker = edit_fingerprint.Walker()
    together = walker.fingerprints(texts)
    for text, row in zip(texts, together):
        assert np.array_equal(edit_fingerprint.Walker().fingerprints([text])[0], row)
