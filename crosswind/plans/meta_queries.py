"""The coefficient meta-learner: reliability weights of factors by date, sleeve scores and their ensemble.

One builder serves both levels: factors inside a sleeve and horizon, and sleeves inside the
ensemble.  Groups are keys, so that all sleeves and horizons are one plan.
"""

from __future__ import annotations

from crosswind.functions.expr import staged
from crosswind.operators.factors import REGISTRY
from crosswind.operators.kernel import zs
from crosswind.plans.panel_queries import EPS, MARKET, P, RETS, _adv, ctes, rd, text
from crosswind.plans.risk_queries import clip, drawdown_ctes, ewm_ctes, roll
from crosswind.sources.panels import run_sql
from crosswind.sources.shared import keyed, signature

#: Sleeves: horizons, sensitivity to stress, and the factors that stand for each in the registered queries.
SLEEVES = {
    "momentum": ((21, 63), -0.60, ("resid_mom", "mom_accel", "trend_consistency")),
    "defensive": ((21,), 0.80, ("inv_vol", "low_beta", "vol_of_vol_inv")),
    "meanrev": ((5, 21), 0.40, ("srev", "ou_zscore", "lrev")),
    "micro": ((5, 21), 0.20, ("ofi_med", "vpin_inv", "micro_noise")),
}
HORIZONS = (5, 21, 63)
#: Least cross-section and history, window of hit rates, and what coverage a factor needs.
LEAST, HISTORY, HIT, COVERAGE = 15, 21, 63, 0.5


def values(rows: list[tuple]) -> str:
    one = lambda v: f"'{v}'" if isinstance(v, str) else repr(v) if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def unpivot(names: list[str], source: str) -> str:
    """(date, asset, factor, score) of the columns of a wide relation, in one pass over it."""
    parts = ", ".join(f"named_struct('factor', '{n}', 'score', {n})" for n in names)
    return f"SELECT date, asset, e.factor AS factor, e.score AS score FROM (SELECT date, asset, explode(array({parts})) AS e FROM {source}) z"


def long_scores(d, names: list[str]) -> tuple[tuple[str, str], ...]:
    wide = staged({n: zs(REGISTRY[n].make()) for n in names}, "panel", d.name)
    if d.spark:
        return (("wide", wide), ("scores", f"SELECT date, asset, factor, round(score, 9) AS score FROM ({unpivot(names, 'wide')}) y"))
    every = " UNION ALL ".join(f"SELECT date, asset, '{n}' AS factor, round({n}, 9) AS score FROM wide" for n in names)
    return (("wide", wide), ("scores", every))


def base(d) -> tuple[tuple[str, str], ...]:
    """``elig``: liquid assets by date; ``fwd`` (date, asset, h, fwd): forward returns by horizon."""
    leads = " UNION ALL ".join(f"SELECT date, asset, {h} AS h, round(f{h}, 9) AS fwd FROM led" for h in HORIZONS)
    return (
        RETS, MARKET, ("a", f"SELECT *, {_adv()} AS adv FROM r"), ("elig", "SELECT date, asset, adv >= 100000 AND c >= 100 AND v > 0 AS ok FROM a"),
        ("led", "SELECT date, asset" + "".join(f", lead(c, {h}) {P} / c - 1 AS f{h}" for h in HORIZONS) + " FROM panel"),
        ("fwd", f"SELECT f.date, f.asset, f.h, f.fwd FROM ({leads}) f JOIN elig e ON e.date = f.date AND e.asset = f.asset WHERE e.ok"),
        ("many", "SELECT date, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n FROM elig GROUP BY date"),
    )


def correlated(a: str, b: str) -> str:
    """Correlation as an aggregate, null without spread on both sides."""
    both = f"(stddev_pop({a}) * stddev_pop({b}))"
    return f"CASE WHEN {both} > {EPS} THEN covar_pop({a}, {b}) / {both} END"


def learned(d, p: str, scores: str, spec: str, lam: float, strength: float, floor: float, least_floor: float) -> tuple[tuple[str, str], ...]:
    """CTEs from ``scores`` (date, asset, factor, score) and ``spec`` (grp, factor, h, proven) to ``{p}_w`` (grp, h, date, factor, weight).

    A date's coefficient is the correlation of average ranks over eligible assets; it counts only
    after its horizon has passed.  Weights: positive means times reliability, less correlation among
    the group's factors, boosted by recent means, no proven factor under its floor.  An active factor with too few recent
    coefficients for a hit rate gets an equal share.
    """
    key, own = "PARTITION BY grp, h, factor ORDER BY date", "PARTITION BY grp, h, date"
    rk = lambda x: f"rank() OVER (PARTITION BY grp, h, factor, date ORDER BY {x}) + (count(*) OVER (PARTITION BY grp, h, factor, date, {x}) - 1) / 2.0"
    lagged = lambda x: "CASE h " + " ".join(f"WHEN {h} THEN lag({x}, {h + 1}) OVER ({key})" for h in HORIZONS) + " END"
    q = 1 - lam
    seen = f"count(ic) OVER ({key})"
    # debiased spread of weights q(1-q)^k with the first at (1-q)^(n-1)
    first = f"pow({lam!r}, 2 * ({seen} - 1))"
    squares = f"({first} + {q * q!r} * (1 - {first}) / {1 - lam * lam!r})"
    return (
        (f"{p}_met", f"SELECT s.grp, s.h, s.factor, x.date, x.score, f.fwd FROM {spec} s JOIN {scores} x ON x.factor = s.factor JOIN fwd f ON f.date = x.date AND f.asset = x.asset AND f.h = s.h WHERE x.score IS NOT NULL AND f.fwd IS NOT NULL"),
        (f"{p}_rk", f"SELECT grp, h, factor, date, {rk('score')} AS a, {rk('fwd')} AS b FROM {p}_met"),
        (f"{p}_raw", f"SELECT grp, h, factor, date, CASE WHEN count(*) >= {LEAST} THEN {correlated('a', 'b')} END AS ic, count(*) AS n FROM {p}_rk GROUP BY grp, h, factor, date"),
        (f"{p}_all", f"SELECT s.grp, s.h, s.factor, s.proven, m.date, round({clip('r.ic', '-0.25', '0.25')}, 9) AS ic, CASE WHEN m.n > 0 THEN coalesce(r.n, 0) / CAST(m.n AS DOUBLE) END AS cov FROM {spec} s CROSS JOIN many m LEFT JOIN {p}_raw r ON r.grp = s.grp AND r.h = s.h AND r.factor = s.factor AND r.date = m.date"),
        (f"{p}_lag", f"SELECT grp, h, factor, proven, date, {lagged('ic')} AS ic, {lagged('cov')} AS cov FROM {p}_all"),
        *ewm_ctes(d, f"{p}_lag", f"{p}_e", q, {"ic1": "ic", "ic2": "ic * ic", "cov1": "cov"}, "grp, h, factor"),
        (f"{p}_st", f"""SELECT grp, h, factor, proven, date, {seen} AS seen, CASE WHEN {seen} >= {HISTORY} THEN ic1 END AS mean,
 CASE WHEN {seen} >= {HISTORY} THEN sqrt(greatest(0.0, ic2 - pow(ic1, 2)) / (1 - {squares})) END AS vol,
 {roll('avg', 'CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END', HIT, max(5, HISTORY // 2), key)} AS hit, count(ic) OVER ({key} ROWS BETWEEN {HIT - 1} PRECEDING AND CURRENT ROW) AS observations,
 CASE WHEN count(cov) OVER ({key}) >= {HISTORY} THEN cov1 END AS cov FROM {p}_e"""),
        (f"{p}_pr", f"SELECT a.grp, a.h, a.factor, b.factor AS other, x.date, CASE WHEN count(*) >= {LEAST} THEN abs({correlated('x.score', 'y.score')}) END AS k FROM {spec} a JOIN {spec} b ON a.grp = b.grp AND a.h = b.h AND a.factor <> b.factor JOIN {scores} x ON x.factor = a.factor JOIN {scores} y ON y.factor = b.factor AND y.date = x.date AND y.asset = x.asset WHERE x.score IS NOT NULL AND y.score IS NOT NULL GROUP BY a.grp, a.h, a.factor, b.factor, x.date"),
        (f"{p}_pe", f"SELECT grp, h, factor, date, 1 - {strength} * (1 - greatest({least_floor}, least(1.0, 1 - coalesce(avg(k), 0)))) AS penalty FROM {p}_pr GROUP BY grp, h, factor, date"),
        (f"{p}_rc", f"SELECT *, {roll('avg', 'mean', 21, 7, key)} AS recent FROM {p}_st"),
        (f"{p}_j", f"SELECT r.grp, r.h, r.factor, r.proven, r.date, r.mean, r.vol, r.hit, r.observations, r.cov, r.recent, coalesce(pe.penalty, 1.0) AS penalty FROM {p}_rc r LEFT JOIN {p}_pe pe ON pe.grp = r.grp AND pe.h = r.h AND pe.factor = r.factor AND pe.date = r.date"),
        (f"{p}_bo", f"SELECT *, coalesce((recent - min(recent) OVER ({own})) / (max(recent) OVER ({own}) - min(recent) OVER ({own}) + {EPS}), 0.5) AS boost, coalesce(mean IS NOT NULL AND cov >= {COVERAGE}, false) AS active FROM {p}_j"),
        (f"{p}_ir", f"SELECT *, CASE WHEN mean IS NOT NULL THEN greatest(0.0, least(3.0, mean / greatest(vol, 0.02))) END AS ir FROM {p}_bo"),
        (f"{p}_u", f"""SELECT *, CASE WHEN active THEN greatest(0.0, mean) * (0.25 + 0.75 * ir / (1 + ir)) * (0.5 + 0.5 * {clip('(hit - 0.40) / 0.20', '0.0', '1.0')}) * sqrt(least(1.0, cov)) * penalty * (1 + 0.10 * boost) ELSE 0.0 END AS u FROM {p}_ir"""),
        (f"{p}_n", f"SELECT *, sum(u) OVER ({own}) AS total, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER ({own}) AS actives, count(*) OVER ({own}) AS every FROM {p}_u"),
        (f"{p}_v", f"SELECT *, greatest(CASE WHEN total > 0 AND u IS NOT NULL THEN u / total WHEN actives > 0 THEN CASE WHEN active THEN 1.0 / actives ELSE 0.0 END ELSE 1.0 / every END, CASE WHEN active AND proven = 1 THEN {floor} ELSE 0.0 END) AS v FROM {p}_n"),
        (f"{p}_w", f"SELECT grp, h, factor, date, mean, vol, ir, hit, observations, cov, active, CASE WHEN sum(v) OVER ({own}) > 0 THEN v / sum(v) OVER ({own}) ELSE 1.0 / every END AS weight FROM {p}_v"),
    )


def composed(p: str, scores: str, weights: str, keys: str = "grp, h") -> tuple[str, str]:
    """``{p}_c`` (keys, date, asset, score): weighted scores over the mass of the weights whose scores are there; 0 without mass."""
    held = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    mass = "sum(CASE WHEN x.score IS NOT NULL THEN greatest(w.weight, 0.0) ELSE 0.0 END)"
    return f"{p}_c", f"SELECT {held}, x.date, x.asset, CASE WHEN {mass} > {EPS} THEN sum(w.weight * x.score) / {mass} ELSE 0.0 END AS score FROM {weights} w JOIN {scores} x ON x.factor = w.factor AND x.date = w.date GROUP BY {held}, x.date, x.asset"


def spec_rows() -> list[tuple]:
    return [(s, n, h, int(REGISTRY[n].proven)) for s, (hs, _, names) in SLEEVES.items() for n in names for h in hs]


NAMES = [n for _, _, own in SLEEVES.values() for n in own]


def factor_level(d) -> tuple[tuple[str, str], ...]:
    """The learner over the factors' scores, which Spark reads as the relation ``scores``."""
    spec = f"SELECT * FROM (VALUES {values(spec_rows())}) AS t(grp, factor, h, proven)"
    return (*base(d), *([] if d.spark else long_scores(d, NAMES)), ("spec", spec), *learned(d, "f", "scores", "spec", 0.95, 0.30, 0.012, 0.25))


def sleeves(d) -> tuple[tuple[str, str], ...]:
    """Sleeve scores, averaged over their horizons."""
    return (*factor_level(d), composed("f", "scores", "f_w"), ("sleeves", "SELECT date, asset, grp AS factor, round(avg(score), 9) AS score FROM f_c GROUP BY date, asset, grp"))


def sleeve_level(d) -> tuple[tuple[str, str], ...]:
    """The learner over the relation ``sleeves``, and weights after the sleeves' sensitivity to stress."""
    spec = f"SELECT * FROM (VALUES {values([('all', s, 21, 1) for s in SLEEVES])}) AS t(grp, factor, h, proven)"
    stress = f"SELECT date, greatest(0.0, least(1.0, dd / (0.10 + {EPS}))) AS stress FROM mdd"
    mult = f"SELECT * FROM (VALUES {values([(s, m) for s, (_, m, _) in SLEEVES.items()])}) AS t(factor, m)"
    return (
        ("spec2", spec), *learned(d, "s", "sleeves", "spec2", 0.94, 0.35, 0.10, 0.25),
        *drawdown_ctes("m", "mkt", "mdd"), ("stress", stress), ("mult", mult),
        ("s_m", "SELECT w.*, t.stress, greatest(0.10, weight * greatest(0.0, 1 + mu.m * t.stress)) AS x FROM s_w w JOIN stress t ON t.date = w.date JOIN mult mu ON mu.factor = w.factor"),
        ("s_x", f"SELECT grp, h, factor, date, stress, x / (sum(x) OVER (PARTITION BY date) + {EPS}) AS weight FROM s_m"),
    )


def ic_state(d):
    """Lagged exponential state of each factor's coefficients by date."""
    return ctes(d, *factor_level(d)) + f"SELECT grp AS sleeve, h, factor, date, {rd('mean')} AS mean, {rd('vol', 5)} AS vol, {rd('ir', 4)} AS ir, {rd('hit')} AS hit, observations, {rd('cov')} AS coverage FROM f_w"


def ic_weights_by_date(d):
    return ctes(d, *factor_level(d)) + f"SELECT grp AS sleeve, h, factor, date, {rd('weight', 5)} AS weight FROM f_w"


def ic_latest(d):
    """The last known value of each metric of each factor."""
    last = lambda x: d.by("max", x, f"CASE WHEN {x} IS NOT NULL THEN date END")
    return ctes(d, *factor_level(d)) + "SELECT grp AS sleeve, h, factor, " + ", ".join(f"{rd(last(x), 4)} AS {x}" for x in ("mean", "vol", "hit", "weight")) + " FROM f_w GROUP BY grp, h, factor"


def sleeve_scores(d):
    return ctes(d, *sleeves(d)) + f"SELECT factor AS sleeve, date, asset, {rd('score', 5)} AS score FROM sleeves"


def _weights(d, before=()):
    return ctes(d, *(before or base(d)), *sleeve_level(d)) + f"SELECT factor AS sleeve, date, {rd('weight', 5)} AS weight, {rd('stress')} AS stress FROM s_x"


def _ensemble(d, before=()):
    return ctes(d, *(before or base(d)), *sleeve_level(d), composed("e", "sleeves", "s_x", "grp")) + f"SELECT date, asset, {rd('score', 5)} AS score FROM e_c"


def _kept(spark, sf_dir, name: str, sql: str, **more):
    return keyed(spark, lambda: run_sql(spark, sf_dir, sql, **more), f"{name}-{signature(spark, [f'{sf_dir}/{t}.parquet' for t in ('lineitem', 'supplier')], sql)}")


def kept_scores(spark, sf_dir):
    """Scores of the sleeves' factors, written once for the tables' files: repeated inside the statements that read them, they were more plan than a driver holds."""
    return _kept(spark, sf_dir, "scores", text(lambda d: ctes(d, *long_scores(d, NAMES)) + "SELECT date, asset, factor, score FROM scores", "spark"))


def kept_sleeves(spark, sf_dir):
    """Sleeve scores, written once as well."""
    return _kept(spark, sf_dir, "sleeves", text(lambda d: ctes(d, *sleeves(d)) + "SELECT date, asset, factor, score FROM sleeves", "spark"), scores=kept_scores(spark, sf_dir))


SQL = {f.__name__: f for f in (ic_state, ic_weights_by_date, ic_latest, sleeve_scores)}
#: Two statements: the second reads the sleeve scores of the first.
ABOVE = {"sleeve_weights": _weights, "ensemble_score": _ensemble}


def queries() -> dict:
    def one(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"), scores=kept_scores(spark, sf_dir))

    def two(f):
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text(f, "spark"), sleeves=kept_sleeves(spark, sf_dir))

    return {n: one(f) for n, f in SQL.items()} | {n: two(f) for n, f in ABOVE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: text(f, "duckdb") for n, f in SQL.items()} | {n: text(lambda d, f=f: f(d, sleeves(d)), "duckdb") for n, f in ABOVE.items()}
