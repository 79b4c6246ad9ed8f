"""Shares of blends as SQL of two dialects: windows over the parts' returns, one step into the box, one exponential mean."""

from __future__ import annotations

from collections.abc import Sequence

from crosswind.operators.construct import Blend
from crosswind.plans.panel_queries import EPS
from crosswind.plans.risk_queries import ewm_ctes

#: How far a Sharpe ratio counts, and dates a year.
FAR, YEAR = 2.5, 252.0


def boxed(source: str, name: str, raw: str, keys: str) -> tuple[tuple[str, str], ...]:
    """``name``: ``source`` and ``share``, raw in proportion, inside (least, most), with sum one.

    What the bounds take or leave is spread by the room to the other bound.  There is as much room at least, as the bounds can be met, so one step is enough.
    """
    over = f"OVER (PARTITION BY {keys})"
    return (
        (f"{name}_c", f"SELECT *, least(most, greatest(least, CASE WHEN sum({raw}) {over} > {EPS} THEN {raw} / sum({raw}) {over} ELSE fixed END)) AS cut FROM {source}"),
        (f"{name}_r", f"SELECT *, 1 - sum(cut) {over} AS spare FROM {name}_c"),
        (f"{name}_m", f"SELECT *, CASE WHEN spare > 0 THEN most - cut ELSE cut - least END AS room FROM {name}_r"),
        (name, f"SELECT *, cut + CASE WHEN sum(room) {over} > {EPS} THEN spare * room / sum(room) {over} ELSE 0.0 END AS share FROM {name}_m"),
    )


def share_ctes(d, pnl: str, blends: Sequence[Blend]) -> tuple[tuple[str, str], ...]:
    """``shares`` (blend, date, strategy_id, share) of ``pnl`` (strategy_id, date, net), from returns before each date only.

    Blends of one window and speed are one set of windows with the blend as a key.  Fixed shares are put into the box where others are chosen.
    """
    for b in blends:
        b.validate()
    literal = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({float(v)!r} AS DOUBLE)"
    spec = ", ".join("(" + ", ".join(map(literal, (b.name, i, w, b.method, b.history, b.least, b.most, b.alpha))) + ")" for b in blends for i, w in b.shares().items())
    out = [
        ("bsp", f"SELECT * FROM (VALUES {spec}) AS t(blend, strategy_id, fixed, method, history, least, most, alpha)"),
        ("bdt", f"SELECT DISTINCT s.blend, p.date FROM bsp s JOIN {pnl} p ON p.strategy_id = s.strategy_id"),
        ("bgr", f"SELECT s.*, t.date, CAST(p.net AS DOUBLE) AS net FROM bsp s JOIN bdt t ON t.blend = s.blend LEFT JOIN {pnl} p ON p.strategy_id = s.strategy_id AND p.date = t.date"),
        ("bpa", "SELECT *, lag(net, 1) OVER (PARTITION BY blend, strategy_id ORDER BY date) AS past FROM bgr"),
        ("bfx", "SELECT blend, date, strategy_id, fixed AS share FROM bpa WHERE method = 'fixed'"),
    ]
    parts = ["SELECT blend, date, strategy_id, share FROM bfx"]
    for k, (window, speed) in enumerate(sorted({(b.window, b.speed) for b in blends if b.method != "fixed"})):
        names = ", ".join(f"'{b.name}'" for b in blends if (b.window, b.speed) == (window, speed) and b.method != "fixed")
        own, a = "PARTITION BY blend, strategy_id ORDER BY date", f"b{k}"
        decay = 1 - 0.5 ** (1 / max(10, window // 3))
        pair = f"OVER (PARTITION BY blend, strategy_id, other ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
        same = f"(stddev_pop(x) {pair} * stddev_pop(y) {pair})"
        out += [
            (f"{a}p", f"SELECT * FROM bpa WHERE blend IN ({names})"), *ewm_ctes(d, f"{a}p", f"{a}e", decay, {"mean": "past"}, "blend, strategy_id"),
            (f"{a}v", f"SELECT *, count(past) OVER ({own}) AS seen, CASE WHEN count(past) OVER ({own} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) >= history THEN stddev_samp(past) OVER ({own} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) * {YEAR ** 0.5!r} END AS vol FROM {a}e"),
            #: Correlations of parts over the dates before, both known; a date counts toward the history if any part is known.
            (f"{a}q", f"SELECT x.blend, x.strategy_id, y.strategy_id AS other, x.date, CASE WHEN y.past IS NOT NULL THEN x.past END AS x, CASE WHEN x.past IS NOT NULL THEN y.past END AS y FROM {a}p x JOIN {a}p y ON y.blend = x.blend AND y.date = x.date"),
            (f"{a}k", f"SELECT blend, strategy_id, other, date, CASE WHEN count(x) {pair} > 1 AND {same} > 0 THEN abs(covar_pop(x, y) {pair} / {same}) END AS k FROM {a}q"),
            (f"{a}a", f"SELECT blend, strategy_id, date, sum(k) AS total, count(*) AS many FROM {a}k GROUP BY blend, strategy_id, date"),
            (f"{a}d", f"SELECT blend, date, max(CASE WHEN past IS NOT NULL THEN 1 ELSE 0 END) AS any_known FROM {a}p GROUP BY blend, date"),
            (f"{a}h", f"SELECT blend, date, coalesce(sum(any_known) OVER (PARTITION BY blend ORDER BY date ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), 0) AS sample FROM {a}d"),
            (f"{a}w", f"""SELECT v.*, CASE WHEN v.method = 'alpha_risk' THEN coalesce(exp(v.alpha * greatest({-FAR!r}, least({FAR!r}, CASE WHEN v.seen >= v.history THEN v.mean END * {YEAR!r} / (v.vol + {EPS})))), 0.0)
 * CASE WHEN h.sample >= v.history THEN 1 / sqrt(0.5 + greatest(0.0, least(1.0, (coalesce(a.total, 0.0) - 1) / greatest(1, a.many - 1)))) ELSE 1.0 END ELSE 1.0 END / (v.vol + {EPS}) AS pull
 FROM {a}v v JOIN {a}a a ON a.blend = v.blend AND a.strategy_id = v.strategy_id AND a.date = v.date JOIN {a}h h ON h.blend = v.blend AND h.date = v.date"""),
            #: Until every part's volatility is known, the fixed shares are wanted.
            (f"{a}f", f"SELECT *, CASE WHEN count(vol) OVER (PARTITION BY blend, date) = count(*) OVER (PARTITION BY blend, date) THEN coalesce(pull, 0.0) ELSE fixed END AS raw FROM {a}w"),
            *boxed(f"{a}f", f"{a}b", "raw", "blend, date"),
            *ewm_ctes(d, f"{a}b", f"{a}s", speed, {"smooth": "share"}, "blend, strategy_id"),
        ]
        parts.append(f"SELECT blend, date, strategy_id, smooth AS share FROM {a}s")
    return (*out, ("shares", " UNION ALL ".join(parts)))
