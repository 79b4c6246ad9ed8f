"""Risk budget and regime of a book as SQL of two dialects: one row per date, windows over dates alone.

Each builder appends CTEs to named relations, so that it runs on any book or market with the same
columns; the registered queries run it on the derived panel.
"""

from __future__ import annotations

import math

from crosswind.operators import regime
from crosswind.plans.panel_queries import EPS, MARKET, P, RETS, Dialect, _book, ctes, growth, rd, text
from crosswind.sources.panels import given_daily, run_sql

D = "ORDER BY date"


def rows(n: int, order: str = D) -> str:
    """A frame of the last n rows."""
    return f"OVER ({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def roll(agg: str, x: str, n: int, least: int, order: str = D) -> str:
    return f"CASE WHEN count({x}) {rows(n, order)} >= {least} THEN {agg}({x}) {rows(n, order)} END"


def ewm(x: str, alpha: float, order: str = D) -> str:
    """DuckDB's exponential mean without adjustment that ignores gaps: the recurrence over the list of known values."""
    return f"list_reduce(list({x}) FILTER (WHERE ({x}) IS NOT NULL) OVER ({order} ROWS UNBOUNDED PRECEDING), lambda a, y: a * {1 - alpha!r} + y * {alpha!r})"


#: Logarithm of the least weight that a running sum keeps relative to its block's first value.
DEEPEST = 300.0


def ewm_ctes(d: Dialect, source: str, name: str, alpha: float, outs: dict[str, str], key: str = "") -> tuple[tuple[str, str], ...]:
    """``name``: ``source`` and the exponential means of expressions by key along dates, unadjusted and ignoring gaps.

    Spark adds values over their weight and multiplies by the weight now.  Sums begin anew after as many values as weights stay in
    range for, and carry the block before on, so that no list is held; what lies further back has no weight.
    """
    by = f"PARTITION BY {key} " if key else ""
    if not d.spark:
        order = f"{by}{D}"
        return ((name, f"SELECT *, {', '.join(f'{ewm(x, alpha, order)} AS {o}' for o, x in outs.items())} FROM {source}"),)
    if alpha >= 1:
        return ((name, f"SELECT *, {', '.join(f'last({x}, true) OVER ({by}{D}) AS {o}' for o, x in outs.items())} FROM {source}"),)
    keep = 1 - alpha
    block = max(1, int(DEEPEST / -math.log(keep)))
    each = lambda text: ", ".join(text.format(o=o, x=x) for o, x in outs.items())
    weight = f"pow({keep!r}, pmod({{o}}_n - 1, {block}))"
    own = f"sum({{o}}_x * CASE WHEN {{o}}_n > 1 THEN {alpha!r} ELSE 1.0 END / {weight}) OVER (PARTITION BY {key + ', ' if key else ''}{{o}}_b {D}) * {weight}"
    older = f"(max(named_struct('d', date, 'v', {{o}}_s)) OVER ({by}ORDER BY {{o}}_b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)).v"
    kept = ", ".join(f"{o}_{c}" for o in outs for c in "xnbs")
    return (
        (f"{name}_n", f"SELECT *, {each('({x}) AS {o}_x, count({x}) OVER (' + by + D + ') AS {o}_n')} FROM {source}"),
        (f"{name}_b", f"SELECT *, {each(f'CAST(floor(({{o}}_n - 1) / {block}) AS INT) AS {{o}}_b')} FROM {name}_n"),
        (f"{name}_s", f"SELECT *, {each(own + ' AS {o}_s')} FROM {name}_b"),
        (name, f"SELECT * EXCEPT ({kept}), {each(f'CASE WHEN {{o}}_n > 0 THEN coalesce({{o}}_s, 0.0) + coalesce({older}, 0.0) * {weight} * {keep!r} END AS {{o}}')} FROM {name}_s"),
    )


def listed(d: Dialect, x: str, n: int, order: str = D) -> str:
    """The known values of the last n rows."""
    return f"collect_list({x}) {rows(n, order)}" if d.spark else f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) {rows(n, order)}"


def mad(d: Dialect, values: str, centre: str) -> str:
    """Median distance of a list's values from a centre."""
    if not d.spark:
        return f"list_median(list_transform({values}, lambda v: abs(v - {centre})))"
    far = f"array_sort(transform({values}, v -> abs(v - {centre})))"
    at = lambda k: f"element_at({far}, CAST((size({values}) + {k}) DIV 2 AS INT))"
    return f"CASE WHEN size({values}) > 0 THEN ({at(1)} + {at(2)}) / 2 END"


def pct_rank(d: Dialect, x: str, values: str) -> str:
    """Average rank of x among a list that holds it, over the list's length."""
    if d.spark:
        below, same, n = f"size(filter({values}, v -> v < {x}))", f"size(filter({values}, v -> v = {x}))", f"size({values})"
    else:
        below, same, n = f"len(list_filter({values}, lambda v: v < {x}))", f"len(list_filter({values}, lambda v: v = {x}))", f"len({values})"
    return f"CASE WHEN {x} IS NOT NULL THEN ({below} + ({same} + 1) / 2.0) / {n} END"


def drawdown_ctes(source: str, x: str, name: str, window: int = 126) -> tuple[tuple[str, str], ...]:
    """``name`` (date, x, nav, dd): distance from the highest point of the last ``window`` dates."""
    return (
        (f"{name}_nav", f"SELECT date, {x}, {growth(x)} AS nav FROM {source}"),
        (f"{name}_peak", f"SELECT *, max(nav) {rows(window)} AS peak FROM {name}_nav"),
        (name, f"SELECT date, {x}, nav, greatest(0.0, least(1.0, (peak - nav) / (peak + {EPS}))) AS dd FROM {name}_peak"),
    )


def panic_ctes(d: Dialect, vol_win: int = 21, base_win: int = 252, dd_on: float = 0.08, dd_full: float = 0.20, z_on: float = 1.0, z_full: float = 3.0) -> tuple[tuple[str, str], ...]:
    """``panic`` (date, dd, vol, vol_z, panic_signal) from the market's drawdown ``mdd``."""
    least = max(63, base_win // 2)
    return (
        ("pv", f"SELECT date, dd, {roll('stddev_samp', 'mkt', vol_win, max(10, vol_win // 2))} * sqrt(252.0) AS vol FROM mdd"),
        ("pb", f"SELECT *, count(vol) {rows(base_win)} AS known, {d.pctl('vol', 0.5)} {rows(base_win)} AS base, {listed(d, 'vol', base_win)} AS vols FROM pv"),
        ("pz", f"SELECT date, dd, vol, CASE WHEN known >= {least} THEN (vol - base) / (1.4826 * ({mad(d, 'vols', 'base')}) + {EPS}) END AS vol_z FROM pb"),
        ("panic", f"SELECT *, coalesce(sqrt({clip(f'(dd - {dd_on}) / {dd_full - dd_on!r}', '0.0', '1.0')} * {clip(f'(vol_z - {z_on}) / {z_full - z_on!r}', '0.0', '1.0')}), 0.0) AS panic_signal FROM pz"),
    )


def breadth_ctes(window: int = 126, smooth: int = 10) -> tuple[tuple[str, str], ...]:
    """``breadth`` (date, breadth): smoothed part of assets whose trailing log return is positive."""
    over = "PARTITION BY asset ORDER BY date"
    return (
        ("bl", "SELECT date, asset, CASE WHEN ret IS NOT NULL THEN ln(1 + greatest(ret, -0.999)) END AS lr FROM r"),
        ("bt", f"SELECT date, {roll('sum', 'lr', window, max(42, window // 2), over)} AS trail FROM bl"),
        ("bs", "SELECT date, avg(CASE WHEN round(trail, 9) > 0 THEN 1.0 WHEN trail IS NOT NULL THEN 0.0 END) AS share FROM bt GROUP BY date"),
        ("breadth", f"SELECT date, {roll('avg', 'share', smooth, max(3, smooth // 2))} AS breadth FROM bs"),
    )


def latch_ctes(source: str, trip: float, rearm: float, name: str = "latched") -> tuple[tuple[str, str], ...]:
    """``name`` (date, kill): on over the trip level, off under the rearm level, else as before."""
    return (
        (f"{name}_e", f"SELECT date, CASE WHEN dd > {trip!r} THEN 1 WHEN dd < {min(rearm, trip)!r} THEN 0 END AS e FROM {source}"),
        (f"{name}_g", f"SELECT date, e, count(e) OVER ({D}) AS k FROM {name}_e"),
        (name, f"SELECT date, coalesce(max(e) OVER (PARTITION BY k), 0) AS kill FROM {name}_g"),
    )


def budget_ctes(d: Dialect, target: float = 0.18, stressed: float = 0.12, lev: tuple = (0.40, 1.5), lam: float = 0.95, stretch: float = 0.70, floor: float = 0.45, overlay_win: int = 63, most_vol: float = 0.22, overlay: tuple = (0.5, 1.25), worst: float = 0.10, kill_mult: float = 1.5, multiplier: str = "") -> tuple[tuple[str, str], ...]:
    """``budget`` (date, ...) of the unit book ``w`` (date, asset, ret, w) under the market's drawdown ``mdd``; last the kill latch.

    A relation ``multiplier`` (date, multiplier) of the regime scales the budget after its overlay, inside the same bounds.
    """
    lo, hi = lev
    return (
        ("bw", f"SELECT date, asset, w, ret, lag(w, 1) {P} AS prior FROM w"),
        ("port", "SELECT date, sum(coalesce(prior * ret, 0)) AS port FROM bw GROUP BY date"), *ewm_ctes(d, "port", "porte", 1 - lam, {"port2": "port * port"}),
        ("pvol", f"SELECT p.date, p.port, mdd.dd, least(1.0, mdd.dd / (0.10 + {EPS})) AS stress, sqrt(p.port2 * 252) AS realized_vol, {roll('stddev_samp', 'p.port', overlay_win, 10, 'ORDER BY p.date')} * sqrt(252.0) AS trailing_vol FROM porte p JOIN mdd ON mdd.date = p.date"),
        ("lever", f"SELECT *, greatest({lo}, least({hi}, ({target} + ({stressed} - {target}) * stress) / (realized_vol + {EPS}))) AS leverage, greatest({floor}, least(1.0, 1 - {stretch} * dd)) AS throttle FROM pvol"),
        ("over1", f"SELECT *, greatest({lo}, least({hi}, leverage * throttle)) AS b1, coalesce({clip(f'throttle * ({clip(f'{target} / (CASE WHEN trailing_vol IS NOT NULL THEN least(trailing_vol, {most_vol}) END + {EPS})', str(overlay[0]), str(overlay[1]))})', str(overlay[0]), str(overlay[1]))}, 1.0) AS overlay FROM lever"),
        ("over2", f"SELECT o.*, greatest({lo}, least({hi}, b1 * overlay)) AS b2 FROM over1 o" if not multiplier else f"SELECT o.*, x.multiplier, greatest({lo}, least({hi}, greatest({lo}, least({hi}, b1 * overlay)) * coalesce(x.multiplier, 1.0))) AS b2 FROM over1 o LEFT JOIN {multiplier} x ON x.date = o.date"),
        ("scaled", f"SELECT date, port * coalesce(lag(b2, 1) OVER ({D}), {lo}) AS scaled FROM over2"),
        *drawdown_ctes("scaled", "scaled", "own"),
        *latch_ctes("own", kill_mult * worst, worst),
        ("budget", "SELECT o.*, l.kill, CASE WHEN l.kill = 1 THEN 0.0 ELSE o.b2 END AS budget FROM over2 o JOIN latched l ON l.date = o.date"),
    )


def market_growth(d):
    """The market's compounded value and its drawdown from the peak of the last 126 dates."""
    return ctes(d, RETS, MARKET, *drawdown_ctes("m", "mkt", "mdd")) + f"SELECT date, {rd('nav')} AS nav, {rd('dd')} AS drawdown FROM mdd"


def panic_state(d):
    return ctes(d, RETS, MARKET, *drawdown_ctes("m", "mkt", "mdd"), *panic_ctes(d)) + f"SELECT date, {rd('dd')} AS market_drawdown, {rd('vol')} AS market_realized_vol, {rd('vol_z', 4)} AS market_vol_z, {rd('panic_signal')} AS panic_signal FROM panic"


def breadth_smoothed(d):
    return ctes(d, RETS, *breadth_ctes()) + f"SELECT date, {rd('breadth')} AS breadth FROM breadth"


def ewma_vol(d):
    return ctes(d, RETS, MARKET, *ewm_ctes(d, "m", "me", 0.05, {"v": "mkt * mkt"})) + f"SELECT date, {rd('sqrt(v * 252)')} AS vol FROM me"


def rolling_ranks(d):
    """Rolling percentile rank and median absolute deviation of each asset's return."""
    over = "PARTITION BY asset ORDER BY date"
    more = (
        ("v", f"SELECT date, asset, round(ret, 9) AS x, {d.pctl('round(ret, 9)', 0.5)} {rows(63, over)} AS centre, {listed(d, 'round(ret, 9)', 63, over)} AS vs FROM r"),
        ("k", f"SELECT date, asset, {'size' if d.spark else 'len'}(vs) AS n, {pct_rank(d, 'x', 'vs')} AS pct, {mad(d, 'vs', 'centre')} AS mad FROM v"),
    )
    return ctes(d, RETS, *more) + f"SELECT date, asset, {rd('CASE WHEN n >= 21 THEN pct END')} AS pct, {rd('CASE WHEN n >= 21 THEN mad END', 11)} AS mad FROM k"


def risk_budget(d):
    return ctes(d, *_book(d), MARKET, *drawdown_ctes("m", "mkt", "mdd"), *budget_ctes(d)) + f"SELECT date, {rd('realized_vol')} AS realized_vol, {rd('leverage')} AS leverage, {rd('throttle')} AS throttle, {rd('overlay')} AS overlay, {rd('budget')} AS budget, kill FROM budget"


def risk_weights(d):
    """The book after its budget, no weight over its cap."""
    return ctes(d, *_book(d), MARKET, *drawdown_ctes("m", "mkt", "mdd"), *budget_ctes(d)) + f"SELECT w.date, w.asset, {rd('least(0.15 * 1.5, w.w * b.budget)')} AS weight FROM w JOIN budget b ON b.date = w.date WHERE w.w > 0"


SQL = {f.__name__: f for f in (market_growth, panic_state, breadth_smoothed, ewma_vol, rolling_ranks, risk_budget, risk_weights)}


def regime_signals(spark, fitted, returns, cfg: dict | None = None):
    """Date-level regime frame from ``fitted`` (date, turbulence, absorption) and ``returns`` (date, asset, ret).

    Signals of turbulence's percentile, absorption's change, breadth and panic are weighted, smoothed
    over five dates, and turned into a throttle, a bounded boost and their product.
    """
    d, c = Dialect("spark"), {"on": 0.90, "full": 0.99, "floor": 0.60, "w_abs": 0.30, "w_breadth": 0.20, "w_panic": 0.20, "cap": 1.05, "warmup": 1.0} | (cfg or {})
    w_turb = max(0.0, 1 - c["w_abs"] - c["w_breadth"] - c["w_panic"])
    more = (
        ("r", "SELECT * FROM {returns}"), MARKET, *drawdown_ctes("m", "mkt", "mdd"), *panic_ctes(d), *breadth_ctes(),
        ("f", f"SELECT date, turbulence, absorption, {listed(d, 'turbulence', 252)} AS ts, {roll('avg', 'absorption', 252, 126)} AS am, {roll('stddev_samp', 'absorption', 252, 126)} AS asd, {roll('avg', 'absorption', 15, 10)} AS a15 FROM {{fitted}}"),
        ("g", f"SELECT date, turbulence, absorption, CASE WHEN size(ts) >= 63 THEN {pct_rank(d, 'turbulence', 'ts')} END AS turb_pct, (a15 - am) / (asd + {EPS}) AS absorption_delta FROM f"),
        ("s", f"""SELECT g.*, {clip(f'(turb_pct - {c["on"]}) / {c["full"] - c["on"]!r}', '0.0', '1.0')} AS turb_signal, coalesce({clip('(absorption_delta - 0.5) / 1.5', '0.0', '1.0')}, 0.0) AS absorption_signal,
 b.breadth, coalesce({clip('(0.45 - b.breadth) / 0.20', '0.0', '1.0')}, 0.0) AS breadth_signal, p.dd AS market_drawdown, p.vol AS market_realized_vol, p.vol_z AS market_vol_z, p.panic_signal
 FROM g JOIN breadth b ON b.date = g.date JOIN panic p ON p.date = g.date"""),
        ("k", f"SELECT *, {w_turb!r} * coalesce(turb_signal, 0.0) + {c['w_abs']} * absorption_signal + {c['w_breadth']} * breadth_signal + {c['w_panic']} * panic_signal AS raw FROM s"),
        *ewm_ctes(d, "k", "q", 1 / 3, {"regime_risk": "raw"}),
        ("t", f"""SELECT *, greatest({c['floor']}, least(1.0, 1 - (1 - {c['floor']}) * regime_risk)) AS throttle,
 coalesce({clip('(breadth - 0.65) / 0.35', '0.0', '1.0')} * {clip('(0.50 - turb_pct) / 0.50', '0.0', '1.0')} * (1 - panic_signal), 0.0) AS risk_on_signal FROM q"""),
        ("u", f"SELECT *, 1 + {max(0.0, c['cap'] - 1)!r} * risk_on_signal AS boost, CASE WHEN turbulence IS NOT NULL THEN 1.0 ELSE 0.0 END AS regime_ready FROM t"),
    )
    least = min(c["floor"], c["warmup"])
    body = "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in more) + f"""
SELECT date, turbulence, turb_pct, turb_signal, absorption, absorption_delta, absorption_signal, breadth, breadth_signal, market_drawdown, market_realized_vol, market_vol_z, panic_signal, regime_risk, throttle,
 risk_on_signal, boost, regime_ready, greatest({least}, least({c['cap']}, least(greatest({least}, least({c['cap']}, throttle * boost)), CASE WHEN regime_ready = 1 THEN {c['cap']} ELSE {c['warmup']} END))) AS multiplier FROM u"""
    return spark.sql(text(lambda _: body, "spark"), returns=returns, fitted=fitted)


def daily_returns(spark, sf_dir):
    """(date, asset, ret, pos) of the regions by day, long enough for the models' windows; pos is the date's number."""
    parts = (*given_daily("spark"), RETS, ("k", "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM r) z"))
    return run_sql(spark, sf_dir, "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\nSELECT r.date, r.asset, r.ret, CAST(k.pos AS INT) AS pos FROM r JOIN k ON k.date = r.date")


def regime_fits(spark, sf_dir):
    """Turbulence and absorption of the regions' returns by date."""
    from pyspark.sql import functions as F

    return regime.regime_by_date(daily_returns(spark, sf_dir)).select("date", F.round("turbulence", 6).alias("turbulence"), F.round("absorption", 6).alias("absorption"))


def regime_frame(spark, sf_dir):
    """The regime frame of the regions by day."""
    returns = daily_returns(spark, sf_dir)
    return regime_signals(spark, regime.regime_by_date(returns), returns.select("date", "asset", "ret"))


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"))

    return {n: one(f) for n, f in SQL.items()} | {"regime_fits": regime_fits, "regime_frame": regime_frame}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()}
