import numpy as np
import pytest

from crosswind.llm import mixing


def test_each_of_many_values_has_its_own_share(spark):
    rows = [(i, "a b c" * (1 + 4 * (i % 3 == 0)), "en", f"site{i}") for i in range(1200)]
    targets = {"source": {"site7": 0.001}}
    mix, _ = mixing.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets)
    assert len({c[0] for c in mix.chance}) == 1200
    light = [mix.chance[c] for c in mix.chance if c[0] == "site8"]
    assert [mix.chance[c] for c in mix.chance if c[0] == "site7"] != light


def test_targets_over_twice_the_share_are_met():
    cells = [(s, g, 0, n) for s, a in (("a", 900), ("b", 100)) for g, n in (("en", 9 * a), ("es", a))]
    chance = mixing.probabilities(cells, {"lang": {"es": 0.5}, "source": {"b": 0.4}})
    kept = {c[:3]: c[3] * chance[c[:3]] for c in cells}
    assert abs(sum(v for c, v in kept.items() if c[1] == "es") / sum(kept.values()) - 0.5) < 1e-6
    assert abs(sum(v for c, v in kept.items() if c[0] == "b") / sum(kept.values()) - 0.4) < 1e-6


def test_a_given_target_that_is_missed_is_an_error():
    with pytest.raises(ValueError):
        mixing.probabilities([("a", "en", 0, 90), ("b", "es", 0, 10)], {"source": {"a": 0.5}, "lang": {"en": 0.9}})


def test_topics_are_fitted_on_all_documents(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[10 * (i % 6) : 10 * (i % 6) + 20], 15))) for i in range(400)]
    table = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, source string, lang string")
    centre = mixing.fit_topics(mixing.vectors_of(table.repartition(3)), topics=4, rows=20)
    x = np.array([mixing.direction(t)[0] for _, t in rows])
    for _ in range(12):
        own = (x @ centre.T).argmax(axis=1)
        want = np.array([x[own == k].sum(axis=0) for k in range(len(centre))])
        want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert len(centre) == 4 and np.abs(want - centre).max() < 0.02


def test_tempered_shares_keep_half_of_the_tokens():
    """Rare cells of skewed data don't take the rate down; what they miss is said."""
    rng = np.random.default_rng(6)
    cells = [(f"s{i}", g, t, int(10 ** rng.uniform(0, 6))) for i in range(40) for g in ("en", "de", None) for t in range(4) if rng.random() < 0.5]
    cells.append(("hot", "en", 0, 50_000_000))
    with pytest.warns(UserWarning):
        chance = mixing.probabilities(cells)
    total = sum(c[3] for c in cells)
    assert sum(c[3] * chance[c[:3]] for c in cells) >= 0.49 * total and max(chance.values()) == 1.0


def test_misses_are_told(spark):
    """Each document has by how much its values' expected shares are over their targets: sums by hand, and none where targets are given."""
    rows = [(i, f"text {i % 7} of words", ("a", "b", None)[i % 3], ("en", "es")[i % 5 == 0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.decide(spark, docs).toPandas()
    weight = got.tokens * got.probability
    for c in ("source", "lang", "topic"):
        values = got[c].astype(object).where(got[c].notna(), None)
        share = got.tokens.groupby(values, dropna=False).sum() / got.tokens.sum()
        goal = share**mixing.TEMPER / (share**mixing.TEMPER).sum()
        reached = weight.groupby(values, dropna=False).sum() / weight.sum()
        want = {k: reached[k] - goal[k] for k in reached.index if k is not None and k == k}
        for k, miss in zip(values, got[f"{c}_miss"]):
            if k is not None:
                assert abs(miss - want[k]) < 1e-9
    met = mixing.decide(spark, docs, {"lang": {"en": 0.5, "es": 0.5}}).toPandas()
    assert met.lang_miss.abs().max() < 1e-6
