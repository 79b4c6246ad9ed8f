"""Operators do the whole job: cases in which a cut would change the result."""

import numpy as np

from crosswind.llm import edit_fingerprint, near_dup


def test_near_fingerprints_are_grouped_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = list(rng.integers(0, 256, (60, 128), dtype=np.uint8))
    for i in range(40):  # pairs at 77 of 128 equal slots, just at the threshold
        row = rows[i].copy()
        row[rng.choice(128, 51, replace=False)] ^= 1
        rows.append(row)
    for _ in range(60):  # edits of one row: near it, in part near each other only
        row = rows[50].copy()
        row[rng.choice(128, int(rng.integers(10, 70)), replace=False)] ^= np.uint8(rng.integers(1, 255))
        rows.append(row)
    # a head, near to none, that two near rows share a band with
    rows[51] = rows[52].copy()
    rows[51][3:] ^= 7
    rows.append(rows[52].copy())
    rows[-1][100:120] ^= 9
    rows = np.array(rows)
    root = np.arange(len(rows))
    for a in range(len(rows)):
        for b in np.flatnonzero(edit_fingerprint.likeness(rows[a][None], rows) >= edit_fingerprint.LEAST):
            root[root == max(root[a], root[b])] = min(root[a], root[b])
    prints = spark.createDataFrame([(i, r.tobytes().hex()) for i, r in enumerate(rows)], "doc_id long, fingerprint string")
    got = np.arange(len(rows))
    for r in edit_fingerprint.near_pairs(prints).collect():
        assert r["near"] >= edit_fingerprint.LEAST
        got[got == max(got[r["a"]], got[r["b"]])] = min(got[r["a"]], got[r["b"]])
    assert got.tolist() == root.tolist() and (root != np.arange(len(rows))).sum() > 80


def test_fingerprint_query_groups_near_texts(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, text), (2, text + " end"), (3, "other words " * 50), (4, text), (5, None)]
    got = edit_fingerprint.with_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), parts=2).toPandas().set_index("doc_id").near_group
    assert got.to_dict() == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert edit_fingerprint.with_groups(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Rows without an id stay; an id with two texts is one document; a repeated row is one."""
    from crosswind.llm import near_dup

    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, a, "x"), (None, a, "y"), (1, a, "z"), (1, b, "z"), (2, a, "z"), (2, a, "z"), (3, a + " more", "z"), (4, "", "z"), (5, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = near_dup.find(spark, docs, near_dup.Settings(2, 80)).collect()
    assert len(got) == 9 and sum(r["doc_id"] is None and r["kept"] and r["component_id"] is None for r in got) == 2
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    left = near_dup.deduplicated(spark, docs, near_dup.Settings(2, 80)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left if r["doc_id"] is not None) == [(False, 1), (False, 4), (False, 5)] and sum(r["doc_id"] is None for r in left) == 2


def test_rows_without_an_id_or_anything_else(spark):
    from crosswind.llm import html_text, lang_mix, license_scan, mixing, packing, quality_qda, rule_lists, url_cascade

    rows = [(None, None, None, None), (None, "some words of a text", "en", "a"), (1, "other words of a text here", "en", "a"), (None, "some words of a text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(None, 1, None), (1, None, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(None, None, None), (None, "http://net/x", "<p>words of a page</p>")], "page_id long, url string, html string")
    for made in (
        packing.pack(spark, docs), license_scan.scan(spark, docs), quality_qda.classify(spark, docs, labels), mixing.decide(spark, docs), mixing.sample(spark, docs),
        edit_fingerprint.with_groups(spark, docs, parts=2), rule_lists.apply(spark, docs, labels), lang_mix.identify(spark, docs),
    ):
        assert made.count() == 4
    assert html_text.extract(pages).count() == 2 == url_cascade.judge(spark, pages).count()


def test_what_near_duplicates_send_to_the_driver_comes_as_columns(spark, monkeypatch):
    """Up to 4,194,304 counters and 524,288 words of bits: as Row objects they take gigabytes of the driver."""
    texts = [" ".join(f"w{(i * 7 + j) % 400}" for j in range(40)) for i in range(30)]
    texts += [t + " more" for t in texts[:10]] + [texts[3], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def rows(self):
        raise AssertionError("rows are made into objects on the driver")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, rows)
    got = near_dup.find(spark, docs).toArrow().sort_by("doc_id")["component_id"].to_pylist()
    assert got == [*range(30), *range(10), 3, 41]
    classes = near_dup.signatures(docs.where("text is not null"), 5)
    sigs = near_dup._rows_of(classes.toArrow()["sig"], near_dup.COORDINATES)
    cells = (near_dup._pairs_of(sigs) >> np.uint64(42)).astype(np.int64).ravel()
    count = np.bincount(cells, minlength=near_dup.COUNTERS)
    assert near_dup._sketch(classes.coalesce(1), near_dup.COORDINATES).tolist() == np.where(count >= 2, count, 0).tolist() and (count >= 2).sum() > 100
