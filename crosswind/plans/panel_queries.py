"""Panel, evaluation, risk, execution and ledger queries as SQL of two dialects.

Every query is one statement over the driver's tables.  The Spark text is what runs; the other
dialect differs only where names do, and is the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from crosswind.functions.expr import E, rounded, staged
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.sources.calendar import calendar_ctes
from crosswind.sources.panels import given, run_sql

EPS = f"CAST({E!r} AS DOUBLE)"


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def pctl(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"

    def by(self, which: str, x: str, k: str) -> str:
        return f"{which}_by({x}, {k})" if self.spark else f"arg_{which}({x}, {k})"

    def skew(self, x: str) -> str:
        return f"(skewness({x}) * sqrt(CAST(count({x}) AS DOUBLE) * (count({x}) - 1)) / (count({x}) - 2))" if self.spark else f"skewness({x})"

    def kurt(self, x: str) -> str:
        n = f"CAST(count({x}) AS DOUBLE)"
        return f"(({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({x}) + 6))" if self.spark else f"kurtosis({x})"

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})" if self.spark else f"date_diff('day', {earlier}, {later})"

    def series(self, start: str, end: str) -> str:
        if self.spark:
            return f"(SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d)"
        return f"(SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS d)"

    def weekday(self, d: str) -> str:
        """0 for Monday to 6."""
        return f"weekday({d})" if self.spark else f"(isodow({d}) - 1)"


R = "CAST(0 AS DOUBLE)"


def rd(x: str, places: int = 6) -> str:
    return f"(round({x}, {places}) + {R})"


def product(x: str) -> str:
    """The aggregate product of 1 + x, defined for any x: signs and zeros are counted apart from the logarithms; null without rows."""
    one = f"(1 + {x})"
    return f"CASE WHEN max(CASE WHEN {one} = 0 THEN 1 ELSE 0 END) = 1 THEN 0.0 ELSE (1 - 2 * (sum(CASE WHEN {one} < 0 THEN 1 ELSE 0 END) % 2)) * exp(sum(CASE WHEN {one} <> 0 THEN ln(abs({one})) END)) END"


def growth(x: str, order: str = "ORDER BY date") -> str:
    """The running product of 1 + x, as ``product``; null counts as 0."""
    over, one = f"OVER ({order})", f"(1 + coalesce({x}, 0))"
    negative = f"(1 - 2 * (sum(CASE WHEN {one} < 0 THEN 1 ELSE 0 END) {over} % 2))"
    logs = f"coalesce(sum(CASE WHEN {one} <> 0 THEN ln(abs({one})) END) {over}, 0)"
    return f"CASE WHEN max(CASE WHEN {one} = 0 THEN 1 ELSE 0 END) {over} = 1 THEN 0.0 ELSE {negative} * exp({logs}) END"


def ctes(d: Dialect, *more: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in (*given(d.name), *more)) + "\n"


P = "OVER (PARTITION BY asset ORDER BY date)"
RETS = ("r", f"SELECT *, c / lag(c, 1) {P} - 1 AS ret, c * v AS dv FROM panel")
MARKET = ("m", "SELECT date, coalesce(avg(ret), 0) AS mkt FROM r GROUP BY date")


def factor_cte(d: Dialect, *names: str) -> str:
    """A relation (date, asset, names...) of scores, as a subquery."""
    return staged({n: REGISTRY[n].make() for n in names}, "panel", d.name)


QUERIES: dict[str, Callable[[Dialect], str]] = {}


def query(f: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    QUERIES[f.__name__] = f
    return f


# --- sources, filters and data quality


@query
def bars_ohlcv(d):
    return ctes(d) + f"SELECT date, asset, {rd('o')} AS o, {rd('h')} AS h, {rd('l')} AS l, {rd('c')} AS c, {rd('v')} AS v FROM bars"


@query
def bars_densify(d):
    return ctes(d) + f"SELECT date, asset, {rd('c')} AS c, {rd('v')} AS v FROM panel"


@query
def dq_validate(d):
    """Counts by rule from one pass over the panel, and a status that is 1 where any rule counts."""
    flag = lambda c: f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)"
    more = (
        ("x", f"SELECT *, c / lag(c, 1) {P} - 1 AS ret, lead(c, 1) {P} / c - 1 AS nxt FROM panel"),
        ("byd", f"SELECT date, count(*) AS n, {flag('c IS NULL')} AS missing, {flag('c <= 0 OR h < l')} AS bad, {flag('abs(ret) > 0.4 AND ret * nxt < -0.04')} AS spikes FROM x GROUP BY date"),
        ("k", "SELECT *, lag(date, 1) OVER (ORDER BY date) AS prev FROM byd"),
        ("t", f"SELECT count(*) AS days, {flag(d.days('date', 'prev') + ' > 5')} AS gaps, sum(missing) / CAST(sum(n) AS DOUBLE) AS missing, {d.by('max', 'missing / CAST(n AS DOUBLE)', 'date')} AS last, sum(bad) AS bad, sum(spikes) AS spikes FROM k"),
        ("u", "SELECT CASE WHEN days < 300 THEN 1 ELSE 0 END AS short_history, gaps AS calendar_gap, CASE WHEN missing > 0.35 THEN 1 ELSE 0 END AS missing_close, CASE WHEN last > 0.25 THEN 1 ELSE 0 END AS missing_last, bad AS bad_price, spikes AS spike FROM t"),
    )
    rules = ("short_history", "calendar_gap", "missing_close", "missing_last", "bad_price", "spike")
    every = [(r, r) for r in rules] + [("degraded", "CASE WHEN " + " + ".join(rules) + " > 0 THEN 1 ELSE 0 END")]
    if d.spark:
        parts = ", ".join(f"'{n}', CAST({x} AS BIGINT)" for n, x in every)
        return ctes(d, *more) + f"SELECT stack({len(every)}, {parts}) AS (rule, n) FROM u"
    return ctes(d, *more) + " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST({x} AS BIGINT) AS n FROM u" for n, x in every)


@query
def bad_print(d):
    more = (("x", f"SELECT *, c / lag(c, 1) {P} - 1 AS ret, lead(c, 1) {P} / c - 1 AS nxt FROM panel"),)
    return ctes(d, *more) + f"SELECT date, asset, {rd('ret')} AS ret, {rd('nxt')} AS nxt FROM x WHERE abs(ret) > 0.4 AND ret * nxt < -0.04"


def _adv(w: int = 20) -> str:
    over = f"OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(dv) {over} >= {max(3, w // 2)} THEN avg(dv) {over} END"


@query
def adv(d):
    return ctes(d, RETS, ("a", f"SELECT date, asset, {_adv()} AS adv FROM r")) + f"SELECT date, asset, {rd('adv', 4)} AS adv FROM a"


@query
def liquidity_mask(d):
    return ctes(d, RETS, ("a", f"SELECT *, {_adv()} AS adv FROM r")) + "SELECT date, asset, coalesce(adv >= 1000000 AND c >= 1000 AND v > 0, false) AS liquid FROM a"


@query
def panel_slice(d):
    return ctes(d) + f"SELECT date, asset, {rd('c')} AS c FROM panel WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"


@query
def restatement(d):
    """Assets whose overlap with a restated table differs by over the tolerance."""
    more = (("fresh", "SELECT date, asset, CASE WHEN asset % 5 = 0 THEN c * 0.5 WHEN asset % 5 = 1 THEN c * 1.0005 ELSE c END AS c FROM bars"),)
    return ctes(d, *more) + f"""SELECT asset, {rd('max(rel)')} AS worst FROM (SELECT a.asset, abs(a.c - f.c) / (abs(a.c) + 1e-9) AS rel FROM bars a JOIN fresh f ON a.date = f.date AND a.asset = f.asset) z
GROUP BY asset HAVING count(*) >= 2 AND max(rel) > 0.002"""


@query
def panel_parity(d):
    more = (
        ("other", "SELECT date, asset, c * (1 + CASE WHEN asset % 7 = 0 THEN 0.01 ELSE 0 END) AS c FROM bars WHERE asset <> 3 AND date >= DATE '1996-01-01'"),
        ("j", "SELECT a.asset, max(abs(a.c - b.c) / (abs(a.c) + 1e-9)) AS worst FROM bars a JOIN other b ON a.date = b.date AND a.asset = b.asset GROUP BY a.asset"),
    )
    return ctes(d, *more) + f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT asset FROM bars EXCEPT SELECT DISTINCT asset FROM other) z) AS only_a,
 (SELECT count(*) FROM (SELECT DISTINCT asset FROM other EXCEPT SELECT DISTINCT asset FROM bars) z) AS only_b,
 (SELECT count(*) FROM j) AS common, (SELECT {rd(d.pctl('worst', 0.5))} FROM j) AS median_worst, (SELECT count(*) FROM j WHERE worst > 0.005) AS over_tolerance"""


@query
def tail_merge(d):
    """Old rows before the first fresh date, then the fresh ones, one a key."""
    more = (
        ("fresh", "SELECT date, asset, c * 1.01 AS c FROM bars WHERE date >= DATE '2001-06-01'"),
        ("u", "SELECT date, asset, c, 0 AS gen FROM bars WHERE date < (SELECT min(date) FROM fresh) UNION ALL SELECT date, asset, c, 1 FROM fresh"),
    )
    return ctes(d, *more) + f"SELECT date, asset, {rd('c')} AS c FROM (SELECT *, row_number() OVER (PARTITION BY date, asset ORDER BY gen DESC) AS k FROM u) z WHERE k = 1"


@query
def membership_asof(d):
    """Membership of assets by the last event on or before each date; none before the first."""
    more = (
        ("ev", "SELECT asset, date, CASE WHEN asset % 2 = 0 THEN true ELSE false END AS member FROM bars WHERE date IN (DATE '1996-01-01', DATE '1998-01-05') UNION ALL SELECT asset, date, true FROM bars WHERE date = DATE '2000-01-03'"),
        ("j", "SELECT p.date, p.asset, e.member FROM panel p LEFT JOIN ev e ON e.date = p.date AND e.asset = p.asset"),
        ("g", f"SELECT *, count(member) {P} AS g FROM j"),
    )
    return ctes(d, *more) + "SELECT date, asset, coalesce(max(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY asset, g), 0) AS member FROM g WHERE g > 0 UNION ALL SELECT date, asset, 0 FROM g WHERE g = 0"


@query
def calendar_days(d):
    """Weekdays without market holidays; see ``sources.calendar``."""
    return f"WITH {calendar_ctes(d, '1995-01-01', '2001-12-31')} SELECT d, w, trading FROM cal"


# --- cross-section, information coefficients and weights


@query
def zscore_mad(d):
    return staged({"z": rounded(zs(REGISTRY["srev"].make()))}, "panel", d.name, given=given(d.name))


@query
def xrank_pct(d):
    return ctes(d, RETS) + f"""SELECT date, asset, {rd("(rank() OVER (PARTITION BY date ORDER BY ret NULLS LAST) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY date)")} AS pct
FROM r WHERE ret IS NOT NULL"""


IC_NAMES = ("srev", "inv_vol", "mom_accel", "resid_mom")


def _ic(d: Dialect, horizon: int = 5, least: int = 15) -> tuple[tuple[str, str], ...]:
    wide = factor_cte(d, *IC_NAMES)
    long = " UNION ALL ".join(f"SELECT date, asset, '{n}' AS factor, {rd(n, 9)} AS score FROM wide" for n in IC_NAMES)
    rk = lambda x: f"rank() OVER (PARTITION BY date, factor ORDER BY {x}) + (count(*) OVER (PARTITION BY date, factor, {x}) - 1) / 2.0"
    return (
        ("wide", wide), ("scores", long), ("fwd", f"SELECT date, asset, {rd(f'lead(c, {horizon}) {P} / c - 1', 9)} AS fwd FROM panel"),
        ("met", "SELECT s.date, s.asset, factor, score, fwd FROM scores s JOIN fwd f ON s.date = f.date AND s.asset = f.asset WHERE score IS NOT NULL AND fwd IS NOT NULL"),
        ("rk", f"SELECT date, factor, {rk('score')} AS a, {rk('fwd')} AS b FROM met"),
        ("ic", f"SELECT date, factor, CASE WHEN count(*) >= {least} THEN corr(a, b) END AS ic, count(*) AS n FROM rk GROUP BY date, factor"),
    )


def rank_ic(d):
    """SQL alone; Spark's form is in ``cross_queries``."""
    return ctes(d, *_ic(d)) + f"SELECT date, factor, {rd('ic')} AS ic, n FROM ic"


@query
def ic_coverage(d):
    return ctes(d, *_ic(d)) + f"""SELECT s.date, s.factor, {rd("CASE WHEN count(f.fwd) > 0 THEN CAST(count(CASE WHEN f.fwd IS NOT NULL THEN s.score END) AS DOUBLE) / count(f.fwd) END")} AS coverage
FROM scores s JOIN fwd f ON s.date = f.date AND s.asset = f.asset GROUP BY s.date, s.factor"""


@query
def ic_summary(d):
    """Mean, spread, ratio and hit rate of each factor's coefficients, lagged past the horizon."""
    return ctes(d, *_ic(d), ("lagged", "SELECT factor, date, lag(ic, 6) OVER (PARTITION BY factor ORDER BY date) AS ic FROM ic")) + f"""SELECT factor, count(ic) AS observations, {rd('avg(ic)')} AS mean_ic,
 {rd('stddev_samp(ic)')} AS ic_vol, {rd('avg(ic) / greatest(stddev_samp(ic), 0.02)')} AS ic_ir, {rd('avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS hit_rate FROM lagged GROUP BY factor"""


def factor_corr_penalty(d):
    """SQL alone; Spark's form is in ``cross_queries``."""
    more = (
        *_ic(d)[:2], ("pairs", f"SELECT a.date, a.factor AS f, CASE WHEN count(*) >= 15 THEN abs(corr(a.score, b.score)) END AS k FROM scores a JOIN scores b ON a.date = b.date AND a.asset = b.asset AND a.factor <> b.factor WHERE a.score IS NOT NULL AND b.score IS NOT NULL GROUP BY a.date, a.factor, b.factor"),
    )
    return ctes(d, *more) + f"SELECT date, f AS factor, {rd('coalesce(avg(k), 0)')} AS mean_corr, {rd('1 - 0.5 * (1 - greatest(0.2, least(1.0, 1 - coalesce(avg(k), 0))))')} AS penalty FROM pairs GROUP BY date, f"


@query
def composite_score(d):
    """Weighted scores over the mass of the weights whose scores are there."""
    weights = "CASE factor WHEN 'srev' THEN 0.4 WHEN 'inv_vol' THEN 0.3 WHEN 'mom_accel' THEN 0.2 ELSE 0.1 END"
    names = {n: zs(REGISTRY[n].make()) for n in IC_NAMES}
    wide = staged(names, "panel", d.name)
    long = " UNION ALL ".join(f"SELECT date, asset, '{n}' AS factor, {n} AS score FROM wide" for n in IC_NAMES)
    return ctes(d, ("wide", wide), ("scores", long)) + f"""SELECT date, asset, {rd(f"CASE WHEN sum(CASE WHEN score IS NOT NULL THEN {weights} ELSE 0 END) > {EPS} THEN sum({weights} * score) / sum(CASE WHEN score IS NOT NULL THEN {weights} ELSE 0 END) ELSE 0 END")} AS score
FROM scores GROUP BY date, asset"""


@query
def quintile_spread(d):
    more = (
        *_ic(d)[:4], ("p", "SELECT date, factor, fwd, (rank() OVER (PARTITION BY date, factor ORDER BY score) + (count(*) OVER (PARTITION BY date, factor, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date, factor) AS q FROM met"),
    )
    return ctes(d, *more) + f"SELECT date, factor, {rd('avg(CASE WHEN q > 0.8 THEN fwd END) - avg(CASE WHEN q < 0.2 THEN fwd END)')} AS spread FROM p GROUP BY date, factor"


def _tstats(d: Dialect) -> tuple[tuple[str, str], ...]:
    """``ts`` (factor, n, mean_ic, t): t statistics of mean coefficients with Bartlett-weighted autocovariances of five lags."""
    var = "g0 + " + " + ".join(f"2 * {1 - k / 6!r} * coalesce(g{k}, 0)" for k in range(1, 6))
    return (
        *_ic(d), ("x", "SELECT factor, date, ic - avg(ic) OVER (PARTITION BY factor) AS e, avg(ic) OVER (PARTITION BY factor) AS mean_ic FROM ic WHERE ic IS NOT NULL"),
        ("y", "SELECT factor, mean_ic, e" + "".join(f", lag(e, {k}) OVER (PARTITION BY factor ORDER BY date) AS e{k}" for k in range(1, 6)) + " FROM x"),
        ("z", "SELECT factor, max(mean_ic) AS mean_ic, count(*) AS n, sum(e * e) AS g0" + "".join(f", sum(e * e{k}) AS g{k}" for k in range(1, 6)) + " FROM y GROUP BY factor"),
        ("ts", f"SELECT factor, n, mean_ic, mean_ic / (sqrt(greatest(({var}) / n / n, {EPS}))) AS t FROM z"),
    )


@query
def nw_tstat(d):
    return ctes(d, *_tstats(d)) + f"SELECT factor, n, {rd('mean_ic')} AS mean_ic, {rd('t', 4)} AS t FROM ts"


def tail(t: str) -> str:
    """Two-sided normal tail of t, by the rational approximation with error under 1e-7."""
    k = f"(1 / (1 + 0.2316419 * abs({t})))"
    poly = f"{k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    return f"(2 * 0.3989422804014327 * exp(-0.5 * {t} * {t}) * {poly})"


@query
def bh_qvalues(d):
    """p values of the factors' t statistics and their step-up false discovery rates."""
    more = (*_tstats(d), ("p", f"SELECT factor, {tail('t')} AS p FROM ts"), ("k", "SELECT factor, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, factor) AS raw FROM p"))
    return ctes(d, *more) + f"SELECT factor, {rd('p', 5)} AS p, {rd('least(1.0, min(raw) OVER (ORDER BY p DESC, factor DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 5)} AS q FROM k"


# --- construction, risk and performance


@query
def seats_topk(d):
    scores = staged({"score": rounded(zs(REGISTRY["srev"].make()))}, "panel", d.name)
    return ctes(d, ("sc", scores)) + "SELECT date, asset, score, seat FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, asset) AS seat FROM sc WHERE score IS NOT NULL) y WHERE seat <= 10"


@query
def cold_start(d):
    """Score multipliers by age and coverage, and the ramp of a position's cap."""
    more = (("a", f"SELECT date, asset, count(c) {P} AS age, CAST(count(c) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS DOUBLE) / 63 AS cov FROM panel"),)
    return ctes(d, *more) + f"SELECT date, asset, age, {rd('CASE WHEN age >= 10 AND cov >= 0.10 THEN sqrt(least(1.0, age / 63.0) * cov) ELSE 0 END')} AS score_mult, {rd('0.25 + 0.75 * least(1.0, age / 63.0)')} AS cap FROM a"


DRAW = (
    ("g", f"SELECT date, mkt, {growth('mkt')} AS nav FROM m"),
    ("dd", "SELECT date, mkt AS ret, nav, (max(nav) OVER (ORDER BY date) - nav) / (max(nav) OVER (ORDER BY date) + 1e-12) AS dd FROM g"),
)


@query
def market_drawdown(d):
    return ctes(d, RETS, MARKET, *DRAW) + f"SELECT date, {rd('greatest(0.0, least(1.0, dd))')} AS drawdown FROM dd"


@query
def kill_latch(d):
    """On over the trip level, off under the rearm level, else as before."""
    more = (("e", "SELECT date, dd, CASE WHEN dd > 0.15 THEN 1 WHEN dd < 0.10 THEN 0 END AS e FROM dd"), ("g2", "SELECT *, count(e) OVER (ORDER BY date) AS k FROM e"))
    return ctes(d, RETS, MARKET, *DRAW, *more) + "SELECT date, coalesce(max(e) OVER (PARTITION BY k), 0) AS latched FROM g2"


def _book(d: Dialect) -> tuple[tuple[str, str], ...]:
    inner = staged({"score": rounded(zs(REGISTRY["srev"].make()), 6)}, "panel", d.name)
    return (
        RETS, ("sc", inner), ("seat", "SELECT date, asset, row_number() OVER (PARTITION BY date ORDER BY score DESC, asset) AS seat FROM sc WHERE score IS NOT NULL"),
        ("w", "SELECT r.date, r.asset, r.ret, CASE WHEN s.seat <= 10 THEN 0.1 ELSE 0 END AS w FROM r LEFT JOIN seat s ON s.date = r.date AND s.asset = r.asset"),
        ("lw", f"SELECT date, asset, ret, w, lag(w, 1) {P} AS held FROM w"),
        # the book of the date before earns, its money left over bears interest, and the first date trades nothing
        ("pnl", "SELECT date, coalesce(sum(held * ret), 0) AS gross, coalesce(sum(abs(w - held)), 0) AS turnover, coalesce(sum(abs(held)), 0) AS exposure FROM lw GROUP BY date"),
        ("net", "SELECT date, gross, turnover, exposure, turnover * 3.0 / 10000 AS tc, greatest(0.0, 1 - exposure) * 0.04 / 252 AS cash, gross - turnover * 3.0 / 10000 + greatest(0.0, 1 - exposure) * 0.04 / 252 AS net FROM pnl"),
    )


@query
def backtest_pnl(d):
    return ctes(d, *_book(d)) + f"SELECT date, {rd('gross')} AS gross_ret, {rd('tc', 8)} AS tc, {rd('cash', 8)} AS cash_yield, {rd('net')} AS net_ret, {rd('turnover')} AS turnover, {rd('exposure')} AS gross_exposure FROM net"


@query
def perf_summary(d):
    more = (("g", f"SELECT date, net, {growth('net')} AS nav FROM net"), ("q", "SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS dd FROM g"))
    return ctes(d, *_book(d), *more) + f"""SELECT count(*) AS days, {rd('avg(net) * 252')} AS mean_annual, {rd('stddev_samp(net) * sqrt(252.0)')} AS vol_annual, {rd(f'avg(net) / (stddev_samp(net) + {EPS}) * sqrt(252.0)')} AS sharpe,
 {rd('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {rd('-min(dd)')} AS max_drawdown, {rd(d.skew('net'), 4)} AS skew, {rd(d.kurt('net'), 4)} AS kurt, {rd(d.pctl('net', 0.05))} AS p05, {rd(d.pctl('net', 0.95))} AS p95 FROM q"""


@query
def benchmark_metrics(d):
    return ctes(d, *_book(d), MARKET, ("j", "SELECT n.date, net, mkt FROM net n JOIN m ON m.date = n.date")) + f"""SELECT {rd('covar_samp(net, mkt) / var_samp(mkt)')} AS beta, {rd('corr(net, mkt)')} AS corr, {rd('avg(net - mkt) * 252')} AS active,
 {rd('avg(net - mkt) / stddev_samp(net - mkt) * sqrt(252.0)')} AS info_ratio, {rd('avg(CASE WHEN mkt > 0 THEN net END) / avg(CASE WHEN mkt > 0 THEN mkt END)')} AS up_capture FROM j"""


@query
def yearly_table(d):
    return ctes(d, *_book(d)) + f"SELECT year(date) AS y, count(*) AS days, {rd(product('net') + ' - 1', 5)} AS ret, {rd('stddev_samp(net) * sqrt(252.0)')} AS vol FROM net GROUP BY year(date) HAVING count(*) >= 40"


@query
def monthly_pivot(d):
    """Compounded returns of each year's months."""
    cells = ", ".join(f"{rd(f'max(CASE WHEN mo = {k} THEN ret END)')} AS m{k:02d}" for k in range(1, 13))
    return ctes(d, *_book(d), ("mr", f"SELECT year(date) AS y, month(date) AS mo, {product('net')} - 1 AS ret FROM net GROUP BY 1, 2")) + f"SELECT y, {cells} FROM mr GROUP BY y"


@query
def rolling_sharpe(d):
    over = "OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    return ctes(d, *_book(d)) + f"SELECT date, {rd(f'CASE WHEN count(net) {over} >= 21 THEN avg(net) {over} / (stddev_samp(net) {over} + {EPS}) * sqrt(252.0) END')} AS sharpe FROM net"


@query
def underwater_run(d):
    """Lengths of the runs under the high-water mark."""
    more = (("u", "SELECT date, CASE WHEN dd > 1e-9 THEN 1 ELSE 0 END AS under FROM dd"), ("i", "SELECT date, under, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY under ORDER BY date) AS island FROM u"))
    return ctes(d, RETS, MARKET, *DRAW, *more) + "SELECT min(date) AS since, count(*) AS days FROM i WHERE under = 1 GROUP BY island"


@query
def cvar(d):
    return ctes(d, *_book(d), ("q", f"SELECT {d.pctl('net', 0.05)} AS q FROM net")) + f"SELECT {rd('max(q)')} AS var05, {rd('avg(CASE WHEN net <= q THEN net END)')} AS cvar05 FROM net CROSS JOIN q"


@query
def stress_matrix(d):
    more = (MARKET, ("j", "SELECT n.date, net, mkt FROM net n JOIN m ON m.date = n.date"), ("q", f"SELECT {d.pctl('mkt', 0.1)} AS lo, {d.pctl('mkt', 0.9)} AS hi FROM m"))
    return ctes(d, *_book(d), *more) + f"SELECT CASE WHEN mkt <= lo THEN 'worst' WHEN mkt >= hi THEN 'best' ELSE 'middle' END AS regime, count(*) AS days, {rd('avg(net)')} AS mean_net FROM j CROSS JOIN q GROUP BY 1"


@query
def corr_matrix(d):
    return ctes(d, RETS) + f"SELECT a.asset AS a, b.asset AS b, {rd('corr(a.ret, b.ret)')} AS corr, count(*) AS n FROM r a JOIN r b ON a.date = b.date AND a.asset < b.asset WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.asset, b.asset"


@query
def rolling_corr(d):
    over = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    return ctes(d, RETS, MARKET, ("j", "SELECT r.date, r.asset, ret, CASE WHEN ret IS NOT NULL THEN mkt END AS mkt FROM r JOIN m ON m.date = r.date")) + f"SELECT date, asset, {rd(f'CASE WHEN count(ret) {over} >= 21 THEN corr(ret, mkt) {over} END')} AS corr FROM j"


@query
def hhi_effective_n(d):
    return ctes(d, ("w", "SELECT date, asset, v / sum(v) OVER (PARTITION BY date) AS w FROM bars"), ("k", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, asset) AS k FROM w")) + f"SELECT date, {rd('sum(w * w)')} AS hhi, {rd('1 / sum(w * w)')} AS effective_n, {rd('max(w)')} AS top1, {rd('sum(CASE WHEN k <= 5 THEN w END)')} AS top5, {rd('sum(CASE WHEN k <= 10 THEN w END)')} AS top10 FROM k GROUP BY date"


@query
def jaccard_overlap(d):
    """Overlap of the traded assets of neighbouring months."""
    more = (("s", "SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS mo, asset FROM bars WHERE asset % 3 <> month(date) % 3"), ("n", "SELECT mo, count(*) AS n FROM s GROUP BY mo"))
    return ctes(d, *more) + f"""SELECT a.mo AS a, b.mo AS b, {rd('CAST(count(*) AS DOUBLE) / (max(na.n) + max(nb.n) - count(*))')} AS jaccard FROM s a JOIN s b ON a.asset = b.asset AND a.mo < b.mo
JOIN n na ON na.mo = a.mo JOIN n nb ON nb.mo = b.mo WHERE {d.days('b.mo', 'a.mo')} <= 31 GROUP BY a.mo, b.mo"""


@query
def markov_counts(d):
    over = "OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    more = (
        ("s1", f"SELECT date, asset, ret, CASE WHEN count(ret) {over} >= 21 THEN stddev_samp(ret) {over} END AS sd FROM r"), ("s2", f"SELECT date, asset, {rd(f'ret / (lag(sd, 1) {P} + {EPS})', 9)} AS z FROM s1"),
        ("s3", "SELECT date, asset, CASE WHEN z IS NULL THEN NULL WHEN z < -1.5 THEN 0 WHEN z < -0.5 THEN 1 WHEN z < 0.5 THEN 2 WHEN z < 1.5 THEN 3 ELSE 4 END AS state FROM s2"), ("s4", f"SELECT state, lead(state, 1) {P} AS nxt FROM s3"),
    )
    return ctes(d, RETS, *more) + "SELECT state, nxt, count(*) AS n FROM s4 WHERE state IS NOT NULL AND nxt IS NOT NULL GROUP BY state, nxt"


@query
def market_breadth(d):
    more = (("b", f"SELECT date, CASE WHEN lag(c, 126) {P} IS NOT NULL AND c IS NOT NULL THEN CASE WHEN ln(c / lag(c, 126) {P}) > 0 THEN 1.0 ELSE 0.0 END END AS up FROM panel"), ("s", "SELECT date, avg(up) AS share FROM b GROUP BY date"))
    return ctes(d, *more) + f"SELECT date, {rd('avg(share) OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS breadth FROM s"


@query
def hit_rate(d):
    over = "OVER (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
    return ctes(d, *_book(d)) + f"SELECT date, {rd(f'CASE WHEN count(net) {over} >= 21 THEN avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) {over} END')} AS hit_rate FROM net"


# --- execution and ledger: orders and their line items stand in for orders and fills

FILLS = "SELECT l_orderkey AS order_id, l_linenumber AS leg, l_partkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice AS notional, l_tax AS fees, l_shipdate AS ts, l_suppkey AS venue FROM lineitem WHERE l_quantity > 0"


@query
def slippage(d):
    """Signed basis points against the symbol's mean price; positive is worse."""
    return f"""WITH f AS ({FILLS}), ref AS (SELECT symbol, side, avg(price) AS ref FROM f GROUP BY symbol, side)
SELECT f.side, count(*) AS fills, {rd('sum(notional)', 2)} AS notional, {rd("avg(CASE WHEN f.side = 'buy' THEN 1 ELSE -1 END * (price / ref - 1) * 10000)", 4)} AS mean_bps, {rd("avg(abs(price / ref - 1) * 10000)", 4)} AS mean_abs_bps,
 {rd("max(CASE WHEN f.side = 'buy' THEN 1 ELSE -1 END * (price / ref - 1) * 10000)", 4)} AS worst_bps FROM f JOIN ref ON ref.symbol = f.symbol AND ref.side = f.side GROUP BY f.side"""


@query
def fills_dedupe(d):
    return f"WITH f AS ({FILLS}) SELECT order_id, leg, symbol, {rd('qty')} AS qty, {rd('price', 9)} AS price FROM (SELECT *, row_number() OVER (PARTITION BY order_id, leg ORDER BY ts, symbol, venue, qty) AS k FROM f) z WHERE k = 1"


@query
def unfilled_antijoin(d):
    return "SELECT o.o_orderkey AS order_id, o.o_orderstatus AS status FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL"


@query
def run_status(d):
    """The worst status of the orders of each day."""
    return "SELECT CAST(o_orderdate AS DATE) AS day, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1"


@query
def equity_drift(d):
    """Basis points by which paper equity grew less or more than the shadow value, by complete row."""
    e = "SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS nav, CASE WHEN count(*) > 3 THEN sum(o_totalprice * 1.001) END AS paper FROM orders GROUP BY 1"
    return f"WITH e AS ({e}), k AS (SELECT * FROM e WHERE paper IS NOT NULL), x AS (SELECT d, nav, paper, lag(nav, 1) OVER (ORDER BY d) AS n0, lag(paper, 1) OVER (ORDER BY d) AS p0 FROM k) SELECT d, {rd('(paper / p0 - nav / n0) * 10000', 2)} AS drift_bps FROM x"


TARGETS = "t AS (SELECT p_partkey AS symbol, (p_partkey % 7) * 1000.0 AS target FROM part)"
HOLD = f"h AS (SELECT symbol, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) AS qty, avg(price) AS price, sum(notional) / 20 AS adv FROM ({FILLS}) f GROUP BY symbol)"


@query
def plan_orders(d):
    """Differences of targets and positions in whole shares, without dust, capped by volume; sells first."""
    return f"""WITH {TARGETS}, {HOLD}, j AS (SELECT coalesce(t.symbol, h.symbol) AS symbol, coalesce(target, 0) AS target, coalesce(qty, 0) AS qty, price, adv FROM t FULL OUTER JOIN h ON t.symbol = h.symbol),
x AS (SELECT *, target - qty * price AS gap FROM j WHERE price > 0), y AS (SELECT *, floor(least(abs(gap), adv * 0.05) / price) AS shares FROM x WHERE abs(gap) >= 100)
SELECT symbol, CASE WHEN gap < 0 THEN 'sell' ELSE 'buy' END AS side, {rd('shares')} AS shares, CASE WHEN target = 0 THEN 'exit' WHEN abs(gap) > adv * 0.05 THEN 'adv_capped' ELSE 'rebalance' END AS reason FROM y WHERE shares > 0"""


@query
def reconcile(d):
    return f"WITH {TARGETS}, {HOLD}, b AS (SELECT sum(abs(qty * price)) AS book FROM h), k AS (SELECT sum(target) AS book FROM t) SELECT coalesce(t.symbol, h.symbol) AS symbol, {rd('coalesce(target, 0) / (SELECT book FROM k) - coalesce(qty * price, 0) / (SELECT book FROM b)', 8)} AS drift FROM t FULL OUTER JOIN h ON t.symbol = h.symbol WHERE abs(coalesce(target, 0) / (SELECT book FROM k) - coalesce(qty * price, 0) / (SELECT book FROM b)) > 0.001"


@query
def quote_board(d):
    """Price by precedence of what is positive, spread and flags, from a user's latest events."""
    last = d.by("max", "value", "struct(ts, event_id)" if d.spark else "row(ts, event_id)")
    return f"""WITH q AS (SELECT user_id AS symbol, event_type, {last} AS value FROM events GROUP BY user_id, event_type),
p AS (SELECT symbol, max(CASE WHEN event_type = 'click' THEN value END) AS bid, max(CASE WHEN event_type = 'view' THEN value END) AS ask, max(CASE WHEN event_type = 'purchase' THEN value END) AS last FROM q GROUP BY symbol)
SELECT symbol, {rd('CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN last > 0 THEN last END')} AS mark, CASE WHEN bid > 0 AND ask > 0 AND abs(ask - bid) / ((bid + ask) / 2) * 10000 > 50 THEN 'VERY WIDE' WHEN bid > 0 AND ask > 0 AND abs(ask - bid) / ((bid + ask) / 2) * 10000 > 25 THEN 'WIDE' ELSE 'OK' END AS spread FROM p"""


@query
def candidate_utility(d):
    """Utility of candidate books: alpha less costs, turnover and risk, with eligibility gates."""
    return f"""WITH k AS (SELECT s_suppkey AS id, s_acctbal / 100 AS alpha_bps, (s_suppkey % 50) / 100.0 AS turnover, 0.10 + (s_suppkey % 9) / 50.0 AS vol FROM supplier),
u AS (SELECT *, alpha_bps - turnover * 2 * 3.0 AS net_bps, turnover * 3 AS turn_pen, greatest(0.0, vol - 0.18) * 10000 * 0.05 AS risk_pen FROM k)
SELECT id, {rd('net_bps')} AS net_bps, {rd('net_bps - turn_pen - risk_pen')} AS utility, turnover <= 0.35 AND net_bps >= -2 AS eligible, row_number() OVER (ORDER BY CASE WHEN turnover <= 0.35 AND net_bps >= -2 THEN 0 ELSE 1 END, round(net_bps - turn_pen - risk_pen, 6) DESC, id) AS place FROM u"""


# --- selection, review and further reports


@query
def expected_alpha(d):
    """Per date the slope through the origin of the next return on the score."""
    more = (*_ic(d, 1)[:4],)
    return ctes(d, *more) + f"SELECT date, factor, {rd('sum(score * fwd) / (sum(score * score) + ' + EPS + ')')} AS slope, count(*) AS n FROM met GROUP BY date, factor"


@query
def ic_weights(d):
    """Weights from mean, ratio, hit rate and coverage of lagged coefficients, with a floor, summing to one."""
    more = (
        *_ic(d), ("lagged", "SELECT factor, date, CASE WHEN lag(ic, 6) OVER (PARTITION BY factor ORDER BY date) IS NOT NULL THEN greatest(-0.25, least(0.25, lag(ic, 6) OVER (PARTITION BY factor ORDER BY date))) END AS ic FROM ic WHERE ic IS NOT NULL"),
        ("st", "SELECT factor, avg(ic) AS m, avg(ic) / greatest(stddev_samp(ic), 0.02) AS ir, avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS hit FROM lagged GROUP BY factor"),
        ("raw", "SELECT factor, greatest(m, 0.0) * (0.25 + 0.75 * greatest(ir, 0.0) / (1 + greatest(ir, 0.0))) * (0.5 + 0.5 * greatest(0.0, least(1.0, (hit - 0.4) / 0.2))) AS w FROM st"),
        ("fl", "SELECT factor, greatest(0.012, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1.0 / count(*) OVER () END) AS w FROM raw"),
    )
    return ctes(d, *more) + f"SELECT factor, {rd('w / sum(w) OVER ()', 5)} AS weight FROM fl"


@query
def recent_metrics(d):
    more = (("k", "SELECT *, row_number() OVER (ORDER BY date DESC) AS k FROM net"),)
    return ctes(d, *_book(d), *more) + f"SELECT {rd('stddev_samp(CASE WHEN k <= 63 THEN net END) * sqrt(252.0)')} AS vol_63, {rd('avg(CASE WHEN k <= 252 THEN net END) / stddev_samp(CASE WHEN k <= 252 THEN net END)')} AS ratio_252, {rd('avg(CASE WHEN k <= 63 THEN turnover END) / 2')} AS one_way_turnover_63 FROM k"


@query
def weekday_month(d):
    return f"SELECT month(o_orderdate) AS mo, {d.weekday('CAST(o_orderdate AS DATE)')} AS w, count(*) AS n, {rd('avg(o_totalprice)', 4)} AS mean_price FROM orders GROUP BY 1, 2"


@query
def return_histogram(d):
    """Sixty bins between the extremes, the last closed."""
    more = (("e", "SELECT min(ret) AS lo, max(ret) AS hi FROM r"), ("x", "SELECT ret, lo, hi FROM r CROSS JOIN e WHERE ret IS NOT NULL"))
    return ctes(d, RETS, *more) + "SELECT CAST(least(59, floor((ret - lo) / (hi - lo) * 60)) AS INT) AS bin, count(*) AS n FROM x GROUP BY 1"


@query
def relative_performance(d):
    more = (MARKET, ("j", "SELECT n.date, net, mkt FROM net n JOIN m ON m.date = n.date"))
    return ctes(d, *_book(d), *more) + f"SELECT date, {rd(f"({growth('net')}) / nullif({growth('mkt')}, 0) - 1", 4)} AS relative FROM j"


@query
def participation(d):
    """How often an asset is held, and its largest and mean weight."""
    return ctes(d, *_book(d)) + f"SELECT asset, {rd('avg(CASE WHEN w > 0 THEN 1.0 ELSE 0.0 END)')} AS held_share, {rd('CAST(max(w) AS DOUBLE)')} AS peak, min(CASE WHEN w > 0 THEN date END) AS first_held FROM w GROUP BY asset"


@query
def market_model(d):
    """Beta, residual alpha, idiosyncratic volatility and fit of every asset."""
    more = (MARKET, ("j", "SELECT r.asset, r.ret, m.mkt FROM r JOIN m ON m.date = r.date WHERE r.ret IS NOT NULL"))
    return ctes(d, RETS, *more) + f"SELECT asset, {rd('covar_samp(ret, mkt) / var_samp(mkt)')} AS beta, {rd('avg(ret) - covar_samp(ret, mkt) / var_samp(mkt) * avg(mkt)')} AS alpha, {rd('corr(ret, mkt) * corr(ret, mkt)')} AS r2, {rd('stddev_samp(ret) * sqrt(1 - corr(ret, mkt) * corr(ret, mkt))')} AS idio_vol FROM j GROUP BY asset"


@query
def factor_exposures(d):
    """Weighted scores of the latest book."""
    wide = staged({n: rounded(zs(REGISTRY[n].make())) for n in IC_NAMES}, "panel", d.name)
    return ctes(d, *_book(d), ("wide", wide), ("lastd", "SELECT max(date) AS date FROM w WHERE w > 0")) + "SELECT " + ", ".join(f"{rd(f'sum(w.w * wide.{n})')} AS {n}" for n in IC_NAMES) + " FROM w JOIN lastd ON w.date = lastd.date JOIN wide ON wide.date = w.date AND wide.asset = w.asset"


@query
def factor_trends(d):
    """Mean coefficients of short and long windows, a slope over time and a state."""
    more = (*_ic(d), ("k", "SELECT factor, ic, CAST(row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS DOUBLE) AS back FROM ic WHERE ic IS NOT NULL"), ("s", "SELECT factor, avg(CASE WHEN back <= 21 THEN ic END) AS short, avg(CASE WHEN back <= 126 THEN ic END) AS long, -regr_slope(ic, back) AS slope FROM k GROUP BY factor"))
    return ctes(d, *more) + f"SELECT factor, {rd('short')} AS short_mean, {rd('long')} AS long_mean, {rd('slope', 8)} AS slope, CASE WHEN short < 0 AND long > 0 THEN 'decaying' WHEN short > long THEN 'improving' ELSE 'stable' END AS state FROM s"


@query
def decision_scorecard(d):
    """Edge over the best, flags, risk points and the call for each candidate."""
    return f"""WITH k AS (SELECT s_suppkey AS id, s_acctbal / 100 AS net_bps, (s_suppkey % 50) / 100.0 AS turnover, 0.10 + (s_suppkey % 9) / 50.0 AS vol, (s_suppkey % 11) / 50.0 AS dd FROM supplier),
x AS (SELECT *, net_bps - (SELECT avg(net_bps) FROM k) AS edge, CASE WHEN turnover > 0.35 THEN 1 ELSE 0 END + CASE WHEN vol > 0.2 THEN 1 ELSE 0 END + CASE WHEN dd > 0.15 THEN 1 ELSE 0 END + CASE WHEN net_bps < -2 THEN 1 ELSE 0 END AS flags FROM k),
y AS (SELECT *, 100 * (0.35 * turnover + 0.25 * dd + 0.20 * vol) + 4 * flags AS risk FROM x)
SELECT id, {rd('edge')} AS edge, flags, {rd('risk')} AS risk_points, {rd('edge - 0.05 * risk')} AS conviction, CASE WHEN net_bps < -2 OR turnover > 0.45 THEN 'BLOCK' WHEN edge > 2 AND flags = 0 THEN 'GREENLIGHT' WHEN edge > 0 THEN 'REVIEW' ELSE 'HOLD CURRENT' END AS play FROM y"""


@query
def explain_delta(d):
    """The focus candidate less each of the eight best others."""
    return f"""WITH k AS (SELECT s_suppkey AS id, s_acctbal / 100 AS utility, (s_suppkey % 50) / 100.0 AS turnover FROM supplier), f AS (SELECT * FROM k WHERE id = 7),
b AS (SELECT * FROM k WHERE id <> 7 ORDER BY utility DESC, id LIMIT 8), o AS (SELECT *, row_number() OVER (ORDER BY utility DESC, id) AS place FROM b)
SELECT o.id, o.place, {rd('f.utility - o.utility')} AS utility_delta, {rd('f.turnover - o.turnover')} AS turnover_delta FROM o CROSS JOIN f"""


@query
def readiness_gates(d):
    """Gates over the ledger and the worst of them."""
    g = """SELECT 'unfilled' AS gate, CASE WHEN count(*) > 500 THEN 2 WHEN count(*) > 0 THEN 1 ELSE 0 END AS level FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL
UNION ALL SELECT 'status', CASE WHEN avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) > 0.5 THEN 2 ELSE 0 END FROM orders UNION ALL SELECT 'bad_price', CASE WHEN count(*) > 0 THEN 2 ELSE 0 END FROM lineitem WHERE l_extendedprice <= 0"""
    return f"WITH g AS ({g}) SELECT gate, CASE level WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS state FROM g UNION ALL SELECT 'all', CASE max(level) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'PASS' END FROM g"


@query
def position_analytics(d):
    largest = "SELECT sum(abs(value)) AS top FROM (SELECT value FROM p ORDER BY abs(value) DESC, symbol LIMIT 5) z"
    return f"""WITH {HOLD}, p AS (SELECT symbol, qty * price AS value FROM h), g AS (SELECT count(*) AS names, sum(abs(value)) AS gross, sum(value) AS net, sum(value * value) AS squares FROM p), t AS ({largest})
SELECT names, {rd('net / gross')} AS net_exposure, {rd('squares / (gross * gross)', 8)} AS hhi, {rd('top / gross')} AS top5 FROM g CROSS JOIN t"""


def text(f: Callable[[Dialect], str], dialect: str) -> str:
    """The statement with all decimal literals as doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1e0", f(Dialect(dialect)))


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"))

    return {n: one(f) for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in QUERIES.items()}
