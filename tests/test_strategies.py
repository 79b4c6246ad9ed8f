"""The registry, scores as a product of matrices, and the choice among strategies against a plain loop."""

import datetime

import numpy as np
import pandas as pd
import pytest

from crosswind.operators import selection
from crosswind.operators.factors import REGISTRY
from crosswind.operators.strategies import BLENDS, STRATEGIES, Book, Strategy, factor_rows
from crosswind.plans import strategy_queries
from crosswind.plans.panel_queries import Dialect
from crosswind.plans.meta_queries import learned, values


def test_registry():
    assert len(STRATEGIES) == 23 and len(BLENDS) == 6 and sum(s.learned for s in STRATEGIES.values()) == 2 and [s.name for s in STRATEGIES.values() if not s.mature] == ["flow_alpha"]
    for s in STRATEGIES.values():
        assert len(set(s.factors)) == len(s.factors) and s.book.least_seats <= s.book.seats <= s.book.most_seats and set(s.factors) <= set(REGISTRY)
    for b in BLENDS.values():
        assert b.faults() == [] and all(i in STRATEGIES for i, _ in b.parts)
    assert len(factor_rows()) == len(set(factor_rows()))
    for bad in (lambda: Strategy("x", ("none",), Book()), lambda: Strategy("x", (), Book()), lambda: Strategy("x", ("srev",), Book(), every=0)):
        with pytest.raises(ValueError):
            bad()


def test_scores_are_weighted_means_of_what_is_known(spark):
    rng = np.random.default_rng(2)
    names, dates = list(REGISTRY), [datetime.date(2024, 1, d) for d in (2, 3)]
    x = rng.normal(size=(2, 6, len(names)))
    x[rng.random(x.shape) < 0.3] = np.nan
    plain = lambda v: None if np.isnan(v) else float(v)
    wide = spark.createDataFrame([(d, a, *map(plain, x[i, a])) for i, d in enumerate(dates) for a in range(6)], "date date, asset long, " + ", ".join(f"{n} double" for n in names))
    w = {(s, f, d): float(rng.uniform(0, 1)) for s, f in factor_rows()[:120] for d in dates}
    got = strategy_queries.combined(wide, spark.createDataFrame([(s, f, d, v) for (s, f, d), v in w.items()], "grp string, factor string, date date, weight double")).collect()
    groups = {s for s, _, _ in w}
    assert len(got) == 2 * 6 * len(groups)
    for r in got:
        own = [(v, x[dates.index(r.date), r.asset, names.index(f)]) for (s, f, d), v in w.items() if s == r.strategy_id and d == r.date]
        known = [(v, z) for v, z in own if not np.isnan(z)]
        assert abs(r.score - (sum(v * z for v, z in known) / sum(v for v, _ in known) if known else 0.0)) < 1e-9


def test_reliability_uses_the_same_rules_as_the_sleeves():
    """The plan over shared coefficients is the meta-learner's but for where coefficients and redundancy come from."""
    names = [n for n, _ in learned(Dialect("spark"), "f", "none", "spec", 0.95, 0.30, 0.012, 0.25)]
    assert {"f_met", "f_rk", "f_raw", "f_pr", "f_pe"} <= set(names) and names[-1] == "f_w" and values([("a", 1)]) == "('a', 1)"


TRAITS = {"a": {"hold": 3, "every": 1, "band": 0.04, "bps": 3.0, "target_vol": 0.15}, "b": {"hold": 2, "every": 4, "band": 0.02, "bps": 4.0, "target_vol": 0.2}, "c": {"hold": 0, "every": 1, "band": 0.04, "bps": 3.0, "target_vol": 0.1}}
POLICIES = [selection.Policy(most_turnover=0.8), selection.Policy("strict", switch=6.0, least_net=1.0), selection.Policy("fixed", most_turnover=0.9, manual="c")]


def market(seed=4, days=60):
    rng = np.random.default_rng(seed)
    dates = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(days)]
    facts = [(s, d, k, float(rng.normal(4, 6)), float(rng.uniform(0.05, 0.25)), int(rng.random() < 0.05)) for k, d in enumerate(dates) for s in "abc"]
    books = []
    held = {s: rng.dirichlet(np.ones(6)) for s in "abc"}
    for d in dates:
        for s in "abc":
            if rng.random() < 0.5:
                held[s] = 0.7 * held[s] + 0.3 * rng.dirichlet(np.ones(6))
            books += [(s, d, f"x{j}", float(w)) for j, w in enumerate(held[s]) if w > 0.02]
    return facts, books


def brute(facts, books, p):
    """One date after the other over aligned series."""
    f = pd.DataFrame(facts, columns=["s", "d", "k", "alpha", "vol", "kill"])
    w = pd.DataFrame(books, columns=["s", "d", "x", "w"]).pivot_table(index=["s", "d"], columns="x", values="w").fillna(0.0)
    name, book, since, last, out = None, 0.0 * w.iloc[0], 0, 0, []
    for d, part in f.groupby("d"):
        k, rows = int(part.k.iloc[0]), []
        for r in part.itertuples():
            t, step = TRAITS[r.s], w.loc[(r.s, d)] - book
            turn = (step.abs().sum() + abs(step.sum())) / 2
            net = r.alpha - 2 * turn * t["bps"]
            utility = net - turn * p.turnover_penalty - max(0, r.vol - t["target_vol"]) * 500
            needed = step.abs().max() >= t["band"] or turn >= max(0.05, t["band"])
            if name is None:
                ok = not r.kill and needed and net >= p.least_net
            else:
                ok = not r.kill and needed and turn <= p.most_turnover and net >= p.least_net and (r.s == name or k - since >= TRAITS[name]["hold"]) and (r.s != name or k - last >= t["every"])
            rows.append((r.s, utility, ok))
        able = sorted((-u, s) for s, u, ok in rows if ok)
        stay = float(part[part.s == name].alpha.iloc[0]) if name else 0.0
        to = None
        if p.manual in [s for _, s in able]:
            to = p.manual
        elif able and (name is None or -able[0][0] >= stay + (p.same if able[0][1] == name else p.switch)):
            to = able[0][1]
        if to:
            since, last, book = k if to != name else since, k, w.loc[(to, d)]
            name = to
        out.append((d, "rebalance" if to else "hold", name, k - since if name else 0))
    return out


def test_choice_equals_a_plain_loop(spark):
    facts, books = market()
    f = spark.createDataFrame(facts, "strategy_id string, date date, pos long, alpha double, vol double, kill int").repartition(5)
    b = spark.createDataFrame(books, "strategy_id string, date date, asset string, weight double").repartition(3)
    got = selection.replay(f, b, TRAITS, POLICIES).toPandas()
    for p in POLICIES:
        own = got[got.policy == p.name].sort_values("date")
        assert list(zip(own.date, own.action, own.held.where(own.held.notna(), None), own.held_days)) == brute(facts, books, p), p.name
    assert {"hold", "rebalance"} == set(got.action) and got[got.policy == "default"].held.nunique() > 1 and set(got.reason) >= {"best beats hold", "within the buffer", "nothing held", "manual"}
    boards = selection.replay(f, b, TRAITS, POLICIES, boards=True).toPandas()
    assert len(boards) == 3 * len(facts) and boards.hold_lock.any() and (~boards.cadence_due).any() and boards[boards.kill].eligible.sum() == 0
    # nothing later counts
    cut = selection.replay(f.where("pos < 30"), b, TRAITS, POLICIES[:1]).toPandas().sort_values("date")
    assert cut.held.tolist() == got[(got.policy == "default") & (got.date < cut.date.max() + datetime.timedelta(days=1))].sort_values("date").held.tolist()


def test_turnover_counts_cash():
    assert selection.turnover({"x": 0.5}, {}) == (0.5, 0.5) and selection.turnover({"x": 0.5}, {"y": 0.5}) == (0.5, 0.5) and selection.turnover({}, {}) == (0.0, 0)
