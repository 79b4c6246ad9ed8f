"""Boards explained: regimes, gates, scorecards, rails, alternatives and books' weights against plain loops over rows."""

import math

import numpy as np
import pytest

from crosswind.operators import trace

BY = ["policy", "day"]
SCHEMA = "policy string, day int, candidate string, strategy string, action string, " + ", ".join(f"{c} double" for c in trace.NUMBERS) + ", " + ", ".join(f"{c} boolean" for c in trace.FLAGS) + ", planned boolean, stale boolean, `a.b` string, place string"
COLUMNS = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]


def made(seed=5):
    """Boards with missing values, ties, one without any eligible row, and one without a row that holds."""
    rng, rows = np.random.default_rng(seed), []
    number = lambda scale: None if rng.random() < 0.1 else float(round(rng.normal(0, scale), 2))
    flag = lambda p: None if rng.random() < 0.15 else bool(rng.random() < p)
    for policy in ("p", "q"):
        for day in range(12):
            for c in ["hold_current"] * (day % 4 != 3) + [f"c{k}" for k in range(int(rng.integers(1, 12)))]:
                hold = c == "hold_current"
                values = [number(9), number(9), number(5), number(1), number(6), number(4), abs(number(0.3) or 0.0), number(0.4), abs(number(0.3) or 0.0), number(0.2)]
                rows.append((policy, day, c, c, "hold" if hold else str(rng.choice(["rebalance", "Switch"])), *values, flag(0.5) if day != 5 else False, *[flag(p) for p in (0.7, 0.7, 0.2, 0.2)], bool(rng.random() < 0.1) if day % 2 else None, day % 3 == 0, "x", "other"))
    at = COLUMNS.index("utility")
    return [(*r[:at], 1.5 if r[1] == 7 else r[at], *r[at + 1 :]) for r in rows]  # on the day 7 all tie


@pytest.fixture(scope="module")
def boards():
    out = {}
    for r in made():
        x = dict(zip(COLUMNS, r))
        out.setdefault((x["policy"], x["day"]), []).append(x | {c: 0.0 if x[c] is None else x[c] for c in trace.NUMBERS} | {"eligible": bool(x["eligible"]), "raw_overlap": x["overlap"]})
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made(), SCHEMA)


def by_board(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["policy"], r["day"]), []).append(r.asDict())
    return out


def test_regimes(frame, boards):
    got = by_board(trace.regimes(frame, BY, "stale"))
    assert got.keys() == boards.keys()
    for key, rows in boards.items():
        (r,) = got[key]
        sample = [x for x in rows if x["eligible"]] or rows
        m = {c: sum(x[c] for x in sample) / len(sample) for c in ("utility", "alpha", "turnover", "risk_penalty", "dd", "vol")}
        soft, old = lambda c, s: math.tanh(m[c] / s), key[1] % 3 == 0
        raw = [
            0.5 + 0.2 * soft("utility", 8) + 0.15 * soft("alpha", 10) - 0.15 * old, 0.25 + 0.2 * soft("risk_penalty", 10) + 0.2 * soft("dd", 0.1),
            0.2 + 0.2 * soft("turnover", 0.25) - 0.1 * soft("utility", 8), 0.15 + 0.2 * soft("vol", 0.2) + 0.25 * old,
        ]
        raw = [max(0.01, v) for v in raw]
        want = [v / sum(raw) for v in raw]
        assert [r[s] for s in trace.STATES] == pytest.approx(want, abs=6e-5) and r[r["state"]] == max(r[s] for s in trace.STATES)
        assert (r["candidates"], r["able"], r["stale"]) == (len(rows), sum(x["eligible"] for x in rows), old)


def test_a_tie_of_states_goes_to_the_first(spark):
    row = dict.fromkeys(COLUMNS) | {"policy": "p", "day": 1, "candidate": "a", "turnover": 1e9, "dd": 1e9, "utility": 0.0, "risk_penalty": -1e9}
    (r,) = trace.regimes(spark.createDataFrame([tuple(row[c] for c in COLUMNS)], SCHEMA), BY).collect()
    assert r.state == "risk_on" and r.risk_off < r.chop < r.risk_on


def test_nodes(frame, boards):
    got = {(r.policy, r.day, r.candidate, r.node): (r.state, r.value) for r in trace.nodes(frame, BY).collect()}
    want = {}
    for (p, d), rows in boards.items():
        for x in rows:
            at = (p, d, x["candidate"])
            want[(*at, "eligible")] = ("PASS" if x["eligible"] else "BLOCK", None)
            for gate, good in (("required", True), ("cadence_due", True), ("hold_lock", False), ("kill", False)):
                if x[gate] is not None:
                    want[(*at, gate)] = ("PASS" if x[gate] == good else "BLOCK", None)
            want[(*at, "turnover")] = ("PASS" if x["turnover"] <= 0.35 else "BLOCK", x["turnover"])
            want[(*at, "utility")] = ("PASS" if x["utility"] >= 0 else "WARN", x["utility"])
    assert got == want


def test_scorecard(frame, boards):
    got = by_board(trace.scorecard(frame, BY))
    order = {c: i for i, c in enumerate(trace.CALLS)}
    for key, rows in boards.items():
        hold = next((x["utility"] for x in rows if x["candidate"] == "hold_current"), 0.0)
        want = []
        for x in rows:
            tests = [("kill switch", x["kill"] is True), ("high turnover", x["turnover"] > 0.35), ("drawdown risk", abs(x["dd"]) > 0.15), ("high vol", x["vol"] > 0.35)]
            tests += [("low overlap", x["raw_overlap"] is not None and x["raw_overlap"] < 0.25 and x["action"].lower() in ("switch", "rebalance")), ("hold lock", x["hold_lock"] is True)]
            tests += [("cadence not due", x["cadence_due"] is False), ("rebalance not required", x["required"] is False and x["action"] != "hold")]
            flags, edge = [n for n, yes in tests if yes], round(x["utility"] - hold, 9)
            points = round(35 * x["turnover"] + 25 * abs(x["dd"]) + 20 * x["vol"] + 0.2 * max(0.0, x["cost"]) + 4 * len(flags), 2)
            if x["candidate"] == "hold_current":
                call = "HOLD BASELINE"
            elif not x["eligible"] or x["kill"]:
                call = "BLOCK"
            else:
                call = "GREENLIGHT" if edge >= 2 and not flags else "REVIEW" if edge >= 0 else "HOLD CURRENT"
            want.append((order[call], -round(edge - 0.05 * points, 6), -x["utility"], x["candidate"], call, ", ".join(flags) or "clear", points))
        own = sorted(got[key], key=lambda r: r["place"])
        assert [(r["candidate"], r["call"], r["flags"]) for r in own] == [w[3:6] for w in sorted(want)]
        assert [r["risk_points"] for r in own] == pytest.approx([w[6] for w in sorted(want)], abs=0.011) and [r["best"] for r in own] == [True] + [False] * (len(own) - 1)


def reasons(x):
    said = [("rebalance not required", x["required"] is False), ("cadence not due", x["cadence_due"] is False), ("hold lock", x["hold_lock"] is True), ("kill switch", x["kill"] is True), ("turnover over the limit", x["turnover"] > 0.35)]
    return [n for n, yes in said if yes]


def test_rails_and_readiness(frame, boards):
    got, ready = by_board(trace.rails(frame, BY)), by_board(trace.readiness(frame, BY, "stale"))
    for key, rows in boards.items():
        assert {r["candidate"]: (r["allowed"], r["reasons"]) for r in got[key]} == {x["candidate"]: (True, "") if x["eligible"] else (False, ", ".join(reasons(x)) or "not eligible under the policy") for x in rows}
        able, old = sum(x["eligible"] for x in rows), key[1] % 3 == 0
        issues = ["no candidate is allowed"] * (able == 0) + ["inputs are stale"] * old
        assert [(r["allowed"], r["issues"], r["status"]) for r in ready[key]] == [(able, ", ".join(issues), "BLOCK" if issues else "PASS")]


@pytest.mark.parametrize("planned", [None, "planned"])
def test_explained(frame, boards, planned):
    got = by_board(trace.explained(frame, BY, planned, most=4))
    for key, rows in boards.items():
        groups = [[x for x in rows if planned and x["planned"]], [x for x in rows if x["eligible"] and x["action"] == "rebalance"], [x for x in rows if x["candidate"] == "hold_current"]]
        led = next((g for g in groups if g), None)
        focus = min(led, key=lambda x: (-x["utility"], x["candidate"])) if led else min(rows, key=lambda x: x["candidate"])
        others = sorted((x for x in rows if x is not focus), key=lambda x: (-x["utility"], x["candidate"]))[:4]
        own = sorted(got.get(key, []), key=lambda r: r["place"])
        assert [(r["focus"], r["candidate"], r["against"]) for r in own] == [(focus["candidate"], x["candidate"], ", ".join(["not eligible"] * (not x["eligible"]) + reasons(x)) or "eligible alternative") for x in others]
        for r, x in zip(own, others):
            assert all(r[f"d_{c}"] == pytest.approx(focus[c] - x[c], abs=6e-6) for c in ("utility", "alpha", "cost", "turnover", "overlap"))


def test_provenance(spark):
    rng, rows = np.random.default_rng(3), []
    for book in range(6):
        rows += [(book, a, None if rng.random() < 0.1 else float(round(rng.normal(0, 0.05), 4))) for a in range(40 * (book % 3))] + [(book, 99, 0.0)]
    rows += [(7, 1, None), (8, 1, 0.02), (8, 2, 0.02), (8, 3, -0.02)]
    got = {r.book: r for r in trace.provenance(spark.createDataFrame(rows, "book int, asset int, weight double"), ["book"], top=5).collect()}
    for book in {b for b, _, _ in rows} - {7}:  # nothing is known of 7
        own = [(a, w) for b, a, w in rows if b == book and w is not None]
        first = [x for x in sorted(own, key=lambda x: (-abs(x[1]), x[0])) if x[1]][:5]
        r = got.pop(book)
        assert r.gross == pytest.approx(sum(abs(w) for _, w in own), abs=6e-6) and r.net == pytest.approx(sum(w for _, w in own), abs=6e-6) and r.positions == sum(w != 0 for _, w in own)
        assert r.effective_n == pytest.approx(1 / sum(w * w for _, w in own) if first else 0.0, abs=6e-3) and r.top_weights == ", ".join(f"{a}={w:.6f}" for a, w in first)
    assert got == {}


def test_frontier(frame, boards):
    expected = [f"c{k}" for k in range(6)] + ["z"]
    got = by_board(trace.frontier(frame, BY, expected))
    for key, rows in boards.items():
        there = {x["strategy"] for x in rows} - {"hold_current"}
        (r,) = got[key]
        gone = sorted(set(expected) - there)
        assert (r["on_board"], r["expected"], r["missing"], r["complete"]) == (len(there), 7, ", ".join(gone), not gone)


def test_no_board(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for df in (trace.regimes(empty, BY), trace.nodes(empty, BY), trace.scorecard(empty, BY), trace.rails(empty, BY), trace.readiness(empty, BY), trace.explained(empty, BY), trace.frontier(empty, BY, ["a"])):
        assert df.count() == 0 and "a.b" not in df.columns
