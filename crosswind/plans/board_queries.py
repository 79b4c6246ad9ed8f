"""The candidate board: books of several strategies measured, gated, ranked, chosen and explained.

Registered queries measure six single-factor strategies on the derived panel; ``board`` works on any
relations of books and P&L by strategy.
"""

from __future__ import annotations

from crosswind.functions.expr import rounded, staged
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.plans.panel_queries import EPS, RETS, Dialect, ctes, growth, rd, text
from crosswind.plans.risk_queries import ewm_ctes
from crosswind.sources.panels import run_sql
from crosswind.sources.shared import keyed, signature

STRATEGIES = ("inv_vol", "mom_accel", "resid_mom", "srev", "ou_zscore", "vol_breakout")
#: Fixed values of the selection policy.
POLICY = {"history": 42, "halflife": 63, "turnover_penalty": 3.0, "risk_scale": 0.05, "target_vol": 0.18, "tc_bps": 3.0, "most_turnover": 0.35, "least_net": -2.0, "same": 0.5, "switch": 2.0, "band": 0.04}
CURRENT = "inv_vol"


def books(d) -> tuple[tuple[str, str], ...]:
    """``bk`` (strategy, date, asset, w, prior, ret, score) and ``bp`` (strategy, date, net, turnover, mkt)."""
    names = {n: rounded(zs(REGISTRY[n].make()), 9) for n in STRATEGIES}
    wide = staged(names, "panel", d.name)
    if d.spark:
        parts = ", ".join(f"'{n}', {n}" for n in names)
        long = f"SELECT date, asset, stack({len(names)}, {parts}) AS (strategy, score) FROM wide"
    else:
        long = " UNION ALL ".join(f"SELECT date, asset, '{n}' AS strategy, {n} AS score FROM wide" for n in names)
    return (
        RETS, ("wide", wide), ("long", long),
        ("seat", "SELECT strategy, date, asset, score, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY strategy, date ORDER BY score DESC NULLS LAST, asset) END AS seat FROM long"),
        ("bk0", "SELECT s.strategy, s.date, s.asset, s.score, r.ret, CASE WHEN s.seat <= 8 THEN 0.12 ELSE 0.0 END AS w FROM seat s JOIN r ON r.date = s.date AND r.asset = s.asset"),
        ("bk", f"SELECT *, lag(w, 1) OVER (PARTITION BY strategy, asset ORDER BY date) AS prior, lead(ret, 1) OVER (PARTITION BY strategy, asset ORDER BY date) AS nxt FROM bk0"),
        ("bp", f"SELECT strategy, date, sum(coalesce(prior * ret, 0)) - sum(abs(w - prior)) * {POLICY['tc_bps']} / 10000 AS net, coalesce(sum(abs(w - prior)), 0) AS turnover, coalesce(avg(ret), 0) AS mkt FROM bk GROUP BY strategy, date"),
    )


def alpha_ctes(d) -> tuple[tuple[str, str], ...]:
    """``al`` (strategy, expected, confidence, observations): slope of next returns on scores and active return, both smoothed.

    A date's slope goes through the origin; the last date has no next return.
    """
    decay, h = 1 - 0.5 ** (1 / POLICY["halflife"]), POLICY["history"]
    return (
        ("sl", f"SELECT strategy, date, sum(score * nxt) / (sum(score * score) + {EPS}) AS slope FROM bk WHERE score IS NOT NULL AND nxt IS NOT NULL GROUP BY strategy, date"),
        *ewm_ctes(d, "sl", "sle", decay, {"mean": "slope"}, "strategy"),
        ("sm", f"SELECT strategy, date, mean AS slope, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY strategy) AS n FROM sle WHERE slope IS NOT NULL"),
        ("ac", f"SELECT strategy, date, net - mkt AS active, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM bp"),
        ("ab", "SELECT * FROM ac WHERE k > 1"), *ewm_ctes(d, "ab", "abe", decay, {"mean": "active"}, "strategy"),
        ("am", f"SELECT strategy, date, mean AS active, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY strategy) AS n FROM abe"),
        ("ls", f"SELECT strategy, asset, {d.by('max', 'score', 'CASE WHEN score IS NOT NULL THEN date END')} AS score, {d.by('max', 'w', 'date')} AS w FROM bk GROUP BY strategy, asset"),
        ("cs", "SELECT strategy, sum(w * coalesce(score, 0)) AS tilt FROM ls GROUP BY strategy"),
        ("al", f"""SELECT c.strategy, s.n AS observations, least(1.0, s.n / {2.0 * h}) AS confidence,
 greatest(-0.01, least(0.01, least(1.0, s.n / {2.0 * h}) * (0.70 * CASE WHEN s.n >= {h} THEN s.slope ELSE 0.0 END * c.tilt + 0.30 * CASE WHEN a.n >= {h} THEN a.active ELSE 0.0 END))) AS expected
 FROM cs c JOIN sm s ON s.strategy = c.strategy AND s.k = 1 JOIN am a ON a.strategy = c.strategy AND a.k = 1"""),
    )


def recent_ctes(d) -> tuple[tuple[str, str], ...]:
    """``rc``: volatility of 63 dates, drawdown, returns and Sharpe of 252, mean one-way turnover."""
    nav = growth("net", "PARTITION BY strategy ORDER BY date")
    return (
        ("rk", "SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date DESC) AS k FROM bp"), ("rn", f"SELECT *, {nav} AS nav FROM rk WHERE k <= 252"),
        ("rp", "SELECT *, max(nav) OVER (PARTITION BY strategy ORDER BY date) AS peak FROM rn"),
        ("rc", f"""SELECT strategy, stddev_samp(CASE WHEN k <= 63 THEN net END) * sqrt(252.0) AS vol, max(1 - nav / peak) AS dd, {d.by('max', 'nav', 'date')} / coalesce(max(CASE WHEN k = 64 THEN nav END), 1.0) - 1 AS r63,
 {d.by('max', 'nav', 'date')} - 1 AS r252, avg(net) / (stddev_samp(net) + {EPS}) * sqrt(252.0) AS sharpe, avg(CASE WHEN k <= 63 THEN turnover END) / 2 AS turn63 FROM rp GROUP BY strategy"""),
    )


def board(d) -> tuple[tuple[str, str], ...]:
    """``bd``: a row for each strategy and one for holding what is held, with costs, utility and gates; Spark reads ``bk`` and ``bp`` as relations."""
    p = POLICY
    return (
        *([] if d.spark else books(d)), *alpha_ctes(d), *recent_ctes(d),
        ("cur", f"SELECT asset, w FROM ls WHERE strategy = '{CURRENT}'"),
        ("dl", "SELECT l.strategy, l.asset, l.w, c.w AS held, l.w - c.w AS delta FROM ls l JOIN cur c ON c.asset = l.asset"),
        ("tv", "SELECT strategy, (sum(abs(delta)) + abs(sum(delta))) / 2 AS turnover, max(abs(delta)) AS change, sum(least(w, held)) AS overlap, sum(w) AS gross, sum(CASE WHEN w > 0.00000001 THEN 1 ELSE 0 END) AS positions FROM dl GROUP BY strategy"),
        ("cd", f"""SELECT t.strategy, t.strategy AS candidate, 'rebalance' AS action, a.expected * 10000 AS alpha, a.confidence, a.observations, t.turnover, t.change, t.overlap, t.gross, t.positions, t.turnover * 2 * {p['tc_bps']} AS cost,
 t.turnover * {p['turnover_penalty']} AS turn_penalty, greatest(0.0, r.vol - {p['target_vol']}) * 10000 * {p['risk_scale']} AS risk_penalty, r.vol, r.dd, r.r63, r.r252, r.sharpe, r.turn63 FROM tv t JOIN al a ON a.strategy = t.strategy JOIN rc r ON r.strategy = t.strategy"""),
        ("cu", f"SELECT *, alpha - cost AS net_alpha, alpha - cost - turn_penalty - risk_penalty AS utility, strategy = '{CURRENT}' AS same, change >= {p['band']} OR turnover >= {max(0.05, p['band'])} AS required FROM cd"),
        ("ce", f"SELECT *, required AND round(turnover, 9) <= {p['most_turnover']} AND round(net_alpha, 9) >= {p['least_net']} AS eligible FROM cu"),
        ("bd", f"""SELECT candidate, strategy, action, alpha, confidence, observations, turnover, change, overlap, gross, positions, cost, turn_penalty, risk_penalty, vol, dd, r63, r252, sharpe, turn63, net_alpha, utility, same, required, eligible FROM ce
 UNION ALL SELECT 'hold_current', strategy, 'hold', alpha, confidence, observations, 0.0, 0.0, gross, gross, positions, 0.0, 0.0, 0.0, vol, dd, r63, r252, sharpe, turn63, alpha, alpha, true, false, true FROM ce WHERE strategy = '{CURRENT}'"""),
    )


def chosen() -> tuple[tuple[str, str], ...]:
    """``ch``: the best eligible candidate, or the hold row if it doesn't beat holding by the buffer."""
    p = POLICY
    return (
        ("be", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(utility, 9) DESC, candidate) AS k FROM bd WHERE eligible AND action = 'rebalance') z WHERE k = 1"),
        ("ch", f"""SELECT h.candidate AS hold, b.candidate AS best, CASE WHEN b.candidate IS NOT NULL AND b.utility >= h.utility + CASE WHEN b.same THEN {p['same']} ELSE {p['switch']} END THEN b.candidate ELSE h.candidate END AS choice,
 CASE WHEN b.candidate IS NULL THEN 'nothing eligible' WHEN b.utility >= h.utility + CASE WHEN b.same THEN {p['same']} ELSE {p['switch']} END THEN 'best beats hold' ELSE 'within the buffer' END AS reason, h.utility AS hold_utility, b.utility AS best_utility
 FROM (SELECT * FROM bd WHERE action = 'hold') h LEFT JOIN be b ON 1 = 1"""),
    )


def candidate_board(d):
    places = {"alpha": 3, "turnover": 5, "change": 5, "overlap": 5, "cost": 3, "risk_penalty": 3, "utility": 3, "vol": 4, "dd": 5, "r63": 4, "r252": 4, "sharpe": 3, "turn63": 5}
    return ctes(d, *board(d)) + "SELECT candidate, strategy, action, observations, positions, " + ", ".join(f"{rd(c, n)} AS {c}" for c, n in places.items()) + ", required, eligible, same FROM bd"


def board_choice(d):
    return ctes(d, *board(d), *chosen()) + f"SELECT choice, best, reason, {rd('hold_utility', 3)} AS hold_utility, {rd('best_utility', 3)} AS best_utility FROM ch"


def board_hash(d):
    """A digest of the sorted board, so that a decision names the board it was made on."""
    row = "concat_ws('|', candidate, strategy, action, CAST(CAST(round(alpha * 1000) AS BIGINT) AS STRING), CAST(CAST(round(turnover * 100000) AS BIGINT) AS STRING), CAST(CAST(round(utility * 1000) AS BIGINT) AS STRING), CASE WHEN eligible THEN 'yes' ELSE 'no' END)"
    if d.spark:
        joined = f"concat_ws(';', transform(array_sort(collect_list(struct(candidate, {row} AS x))), e -> e.x))"
        return ctes(d, *board(d)) + f"SELECT substr(sha2({joined}, 256), 1, 24) AS board_hash, count(*) AS n FROM bd"
    return ctes(d, *board(d)) + f"SELECT substr(sha256(string_agg({row.replace('STRING', 'VARCHAR')}, ';' ORDER BY candidate)), 1, 24) AS board_hash, count(*) AS n FROM bd"


def board_blockers(d):
    """What keeps each candidate from being chosen, and how far it is from the chosen one."""
    p = POLICY
    parts = [("not required", "NOT required"), ("turnover", f"round(turnover, 9) > {p['most_turnover']}"), ("net alpha", f"round(net_alpha, 9) < {p['least_net']}")]
    text_ = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in parts) + ")"
    return ctes(d, *board(d), *chosen(), ("f", "SELECT b.* FROM bd b JOIN ch ON ch.choice = b.candidate")) + f"""SELECT b.candidate, CASE WHEN b.action = 'hold' THEN '' ELSE {text_.replace('required', 'b.required').replace('turnover,', 'b.turnover,').replace('net_alpha', 'b.net_alpha')} END AS blockers,
 {rd('b.utility - f.utility', 3)} AS d_utility, {rd('b.turnover - f.turnover', 5)} AS d_turnover, {rd('b.alpha - f.alpha', 3)} AS d_alpha, {rd('b.cost - f.cost', 3)} AS d_cost, row_number() OVER (ORDER BY round(b.utility, 9) DESC, b.candidate) AS place FROM bd b CROSS JOIN f"""


def decision_card(d):
    """Edge over holding, risk points, flags and the play that they call for."""
    points = "CASE WHEN vol > 0.35 THEN 2 WHEN vol > 0.22 THEN 1 ELSE 0 END + CASE WHEN dd > 0.3 THEN 2 WHEN dd > 0.15 THEN 1 ELSE 0 END + CASE WHEN turnover > 0.3 THEN 1 ELSE 0 END"
    return ctes(d, *board(d), ("h", "SELECT utility AS u FROM bd WHERE action = 'hold'"), ("e", f"SELECT bd.*, utility - h.u AS edge, {points} AS points FROM bd CROSS JOIN h")) + f"""SELECT candidate, {rd('edge', 3)} AS edge, points,
 CASE WHEN action = 'hold' THEN 'HOLD' WHEN NOT eligible THEN 'BLOCKED' WHEN round(edge, 9) >= {POLICY['switch']} AND points <= 2 THEN 'GO' WHEN round(edge, 9) >= 0 THEN 'WATCH' ELSE 'PASS' END AS play FROM e"""


def utility_waterfall(d):
    """Each candidate's utility as steps from its alpha."""
    steps = (("alpha", "alpha"), ("cost", "-cost"), ("turnover", "-turn_penalty"), ("risk", "-risk_penalty"), ("utility", "utility"))
    if d.spark:
        return ctes(d, *board(d)) + f"SELECT candidate, step, {rd('value', 3)} AS value FROM (SELECT candidate, stack(5, {', '.join(f"'{n}', {x}" for n, x in steps)}) AS (step, value) FROM bd) z"
    return ctes(d, *board(d)) + " UNION ALL ".join(f"SELECT candidate, '{n}' AS step, {rd(x, 3)} AS value FROM bd" for n, x in steps)


SQL = {f.__name__: f for f in (candidate_board, board_choice, board_hash, board_blockers, decision_card, utility_waterfall)}


def kept_books(spark, sf_dir) -> dict:
    """``bk`` and ``bp``, kept once for the tables' files: a board reads them many times, and a plan that holds a copy of all factors for each takes the driver's memory."""
    *first, (_, paid) = books(Dialect("spark"))
    rows = text(lambda d: ctes(d, *first) + "SELECT strategy, date, asset, score, ret, w, prior, nxt FROM bk", "spark")
    paid = text(lambda _: paid, "spark")
    sign = signature(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier")], rows, paid)
    bk = keyed(spark, lambda: run_sql(spark, sf_dir, rows), f"board-rows-{sign}")
    return {"bk": bk, "bp": keyed(spark, lambda: run_sql(spark, sf_dir, paid, bk=bk), f"board-pnl-{sign}")}


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"), **kept_books(spark, sf_dir))

    return {n: one(f) for n, f in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()}
