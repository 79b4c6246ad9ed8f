"""The factor registry: causal scores of assets by date, higher is more attractive.

Each factor is a staged expression over the dense panel (see ``functions.expr``).  Windows,
least counts and factors of the formulas are fixed values of the definitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from crosswind.functions.expr import E, X, absolute, b01, clip, coalesce, fn, held, if_, lag, lift, ln, neg_part, pos, roll, roll2, sign, sqrt, total, xrank, xs
from crosswind.operators.kernel import (
    Ou, acf1, atr, beta, breadth, c, cbeta, cloc, cpos, down, dv, grown, h, intra, l, mkt, o, ofi, on, pcov, pct, r3, r5, r21, r63, ravg, rdv, resid, ret, rmax, rmed, rmin, rstd, rsum, rvar, sv, tr, v, vpin, xrank2, zs,
)


@dataclass(frozen=True)
class Factor:
    name: str
    sleeve: str
    proven: bool
    make: Callable[[], X]


REGISTRY: dict[str, Factor] = {}


def factor(sleeve: str, proven: bool = True):
    """Registers a function without arguments under its own name; the first registration of a name stays."""

    def add(make: Callable[[], X]) -> Callable[[], X]:
        REGISTRY.setdefault(make.__name__, Factor(make.__name__, sleeve, proven, cache(make)))
        return make

    return add


def add(sleeve: str, proven: bool, **made: Callable[[], X]) -> None:
    for name, make in made.items():
        make.__name__ = name
        factor(sleeve, proven)(make)


def _range_share() -> X:
    return (c - l) / (h - l + E)


def _normed(x: X, w: int, n: int) -> X:
    """Sum of returns over their spread."""
    return rsum(x, w, max(2, n)) / (rstd(ret, 42, 21) * w**0.5 + E)


add(
    "defensive", True,
    inv_vol=lambda: 1.0 / (rstd(ret, 52, 26) + E),
    inv_downside=lambda: 1.0 / (sqrt(ravg(neg_part(ret) * neg_part(ret), 52, 26)) + E),
    low_beta=lambda: -beta(126, 63),
    beta_stability=lambda: -rstd(beta(52, 26), 52, 26),
    amihud_inv=lambda: -ravg(absolute(ret) / (dv + E), 42, 21),
    vol_of_vol_inv=lambda: -rstd(rstd(ret, 21, 10), 52, 26),
    skew_pref=lambda: roll("skew", ret, 63, 21),
    kurtosis_inv=lambda: -clip(roll("kurt", ret, 63, 21), -10.0, 20.0),
    max_lottery=lambda: -rmax(ret, 21, 15),
    turnover_vol_inv=lambda: -rstd(v / (ravg(v, 126, 63) + E), 42, 21),
    inv_idio=lambda: 1.0 / (rstd(resid, 52, 26) + E),
    low_corr=lambda: -roll2("corr", ret, mkt, 52, 26),
    liquidity=lambda: ln(1.0 + ravg(dv, 63, 31)),
    downside_beta_resilience=lambda: -cbeta(mkt < 0.0, 126, 42),
)
add(
    "momentum", True,
    mom_12_1=lambda: lag(pct(252), 21),
    resid_mom=lambda: ravg(resid, 84, 42),
    resid_mom_short=lambda: ravg(resid, 21, 10),
    trend_consistency=lambda: ravg(b01(ret > 0.0), 84, 42),
    prox_52w_high=lambda: c / (rmax(h, 252, 126) + E),
    slope_ema=lambda: (ema(c, 16) - ema(c, 42)) / (c + E),
    breakout=lambda: (c - lag(rmax(h, 63, 42))) / (rstd(c, 63, 42) * 63**0.5 + E),
    mom_accel=lambda: pct(21) - (pct(84) - pct(21)) / 3.0,
    momentum_quality=lambda: clip(ravg(ret, 84, 42) / (rstd(ret, 84, 42) + E), -5.0, 5.0),
    momentum_persistence=lambda: clip(acf1(ret, 42, 21), -1.0, 1.0),
    overnight_bias=lambda: ravg(on, 21, 10),
    attention_momentum=lambda: ravg(sign(ret) * (clip(v / (ravg(v, 63, 31) + E), 0.1, 10.0) - 1) * absolute(clip(ret / (rstd(ret, 21, 10) + E), -3.0, 3.0)), 10, 5),
    anchoring_bias=lambda: 0.6 * c / (rmax(h, 252, 126) + E) + 0.4 * (c - rmin(l, 252, 126)) / (rmax(h, 252, 126) - rmin(l, 252, 126) + E),
    efficiency_ratio=lambda: clip(absolute(c - lag(c, 21)) / (rsum(absolute(c - lag(c)), 21, 21) + E) * sign(c - lag(c, 21)), -1.0, 1.0),
    capm_alpha=lambda: ravg(ret, 84, 42) - beta(84, 42) * ravg(mkt, 84, 42),
    fip_momentum=lambda: _fip(),
    intermediate_momentum=lambda: lag(c, 126) / (lag(c, 252) + E) - 1,
    multi_horizon_trend=lambda: _trends(),
    residual_trend_tstat=lambda: clip(ravg(resid, 126, 63) / (rstd(resid, 126, 63) + E) * 126**0.5, -6.0, 6.0),
)
add(
    "meanrev", True,
    srev=lambda: -pct(5),
    ou_zscore=lambda: -Ou(63).z,
    ou_predicted_return=lambda: Ou(63).theta * (Ou(63).mu - ln(c)),
    ou_mom_blend=lambda: _ou_blend(),
    mean_reversion_speed=lambda: clip(-acf1(held((c - ema(c, 42)) / (ema(c, 42) + E)), 63, 21, 31), -1.0, 1.0),
    disposition_alpha=lambda: _disposition(),
    resid_srev=lambda: -rsum(resid, 5, 3),
)
add(
    "micro", False,
    ofi_med=lambda: ofi(21),
    mtf_ofi_alignment=lambda: (sign(ofi(5)) + sign(ofi(21)) + sign(ofi(63))) * (absolute(ofi(5)) + absolute(ofi(21)) + absolute(ofi(63))) / 3.0,
    vpin_inv=lambda: -vpin(42),
    kyle_lambda_inv=lambda: -pcov(ret, sv, 42, 21) / (rvar(sv, 42, 21) + E),
    bvc_imbalance=lambda: _bvc(),
    exec_quality=lambda: (zs(-ravg(ln(h / (l + E) + E), 21, 10)) + zs(-ravg(absolute(ret) / (dv + E), 21, 10)) + zs(dv / (ravg(dv, 63, 31) + E)) + zs(-vpin(42))) / 4.0,
    flow_persistence=lambda: clip(acf1(ofi(5), 10, 5), -1.0, 1.0) * ofi(5),
    obv_trend=lambda: _obv(),
)
add("defensive", True, cross_sectional_dispersion=lambda: _dispersion(), gk_inv_vol=lambda: _garman(), drawdown_resilience=lambda: rmin(_depth(), 126, 63) + 0.25 * _depth())
add(
    "defensive", False,
    micro_noise=lambda: -absolute(ln(fn("greatest", rvar(rsum(ret, 5, 5), 42, 21) / (5.0 * rvar(ret, 42, 21) + E), E))),
    calm_flow=lambda: -(ravg(v, 5, 3) / (ravg(v, 63, 32) + E) - 1),
    vol_surprise=lambda: v / (ravg(v, 21, 10) + E) - 1,
    idio_tail_risk=lambda: roll("quantile", resid, 63, 31, 0.05),
    beta_asymmetry=lambda: clip(cbeta(mkt > 0.0, 126, 42) - cbeta(mkt < 0.0, 126, 42), -3.0, 3.0),
    gap_resilience=lambda: -sqrt(ravg(neg_part(on) * neg_part(on), 63, 31)),
    correlation_shock_resilience=lambda: -clip(roll2("corr", if_(mkt < 0.0, ret), if_(mkt < 0.0, mkt), 126, 42) - roll2("corr", ret, mkt, 126, 63), -2.0, 2.0),
)
add(
    "meanrev", False,
    ou_zscore_short=lambda: -Ou(21).z,
    ou_halflife_signal=lambda: 1.0 / (Ou(63).half_life + E),
    lrev=lambda: -r21,
    range_rejection=lambda: _rejection(),
    gap_reversal_pressure=lambda: clip(ravg(-sign(on) * intra / (_atr_before() + E) * sqrt(1.0 + clip(absolute(on) / (_atr_before() + E), 0.0, 5.0)), 5, 3), -5.0, 5.0),
    exhaustion_reversal=lambda: _exhaustion(),
    downside_absorption_reversal=lambda: clip(clip(-r3 / (3**0.5 * (_atr_now() + E)), 0.0, 6.0) * (1.0 + cpos) * sqrt(rdv(3, 63)) * clip(pos(intra) / (_atr_now() + E), 0.0, 4.0), -5.0, 5.0),
    failed_breakdown_reclaim=lambda: _reclaim(),
)
add(
    "momentum", False,
    overnight_intraday_tug=lambda: rsum(on, 21, 10) - rsum(intra, 21, 10),
    liquidity_momentum=lambda: rsum(resid, 84, 42) * sqrt(clip(ravg(dv, 21, 10) / (xs("median", ravg(dv, 21, 10)) + E), 0.25, 4.0)),
    vol_scaled_momentum=lambda: (lag(c, 21) / (lag(c, 252) + E) - 1) / (rstd(ret, 63, 32) * 252**0.5 + E),
    return_seasonality=lambda: _season(),
    ma_cloud=lambda: (c - ravg(c, 50, 25)) / (atr(14) + E) + (c - ravg(c, 200, 100)) / (atr(14) + E),
    vol_breakout=lambda: (atr(14) / (ravg(atr(14), 20, 10) + E) - 1) * sign(r21),
    hloc_close_position=lambda: (c - rmin(l, 21, 10)) / (rmax(h, 21, 10) - rmin(l, 21, 10) + E),
    momentum_divergence=lambda: rsum(lag(ret, 21), 231, 115) - rsum(lag(resid, 21), 231, 115),
    volume_confirmed_breakout=lambda: clip((c - lag(rmax(h, 63, 42))) / (ravg(h - l, 21, 10) + E), -4.0, 4.0) * sqrt(clip(dv / (rmed(dv, 63, 32) + E), 0.25, 4.0)) + 0.25 * cloc,
    channel_pressure=lambda: _channel(),
    compression_thrust=lambda: clip(clip(rmed(atr(14), 126, 63) / (ravg(atr(14), 20, 10) + E), 0.25, 4.0) * r5 / (atr(14) / (c + E) + E), -6.0, 6.0),
    gap_continuation=lambda: clip(rsum(sign(on) * intra * sqrt(1.0 + clip(absolute(on) / (_atr_before() + E), 0.0, 4.0)), 10, 5), -5.0, 5.0),
    range_participation=lambda: clip(cloc * clip(tr / (rmed(tr, 21, 10) + E), 0.25, 4.0) * sqrt(clip(dv / (rmed(dv, 63, 32) + E), 0.25, 4.0)), -5.0, 5.0),
    liquidity_squeeze_breakout=lambda: clip(clip(rmed(tr, 63, 32) / (ravg(tr, 10, 5) + E), 0.25, 5.0) * clip((c / (lag(rmax(h, 42, 21)) + E) - 1) / (_atr_before() + E), -5.0, 5.0) * sqrt(rdv(5, 63)), -6.0, 6.0),
    pullback_reclaim=lambda: _pullback(),
    opening_drive_continuation=lambda: clip(ravg(sign(on) * intra / (_atr_before() + E) * sqrt(rdv(3, 63)) * (1.0 + absolute(cloc)), 3, 2), -5.0, 5.0),
    range_volume_acceleration=lambda: clip(clip((r3 - r21 / 7.0) / (3**0.5 * (_atr_now() + E)), -6.0, 6.0) * sqrt(clip(ravg(tr, 3, 2) / (rmed(tr, 21, 10) + E), 0.25, 4.0)) * sqrt(rdv(3, 63)) + ravg(sign(ret), 8, 4), -6.0, 6.0),
    residual_momentum_acceleration=lambda: clip((rsum(resid, 5, 3) - rsum(resid, 21, 10) / (21 / 5) ** 0.5 / 4.0) / (rstd(resid, 42, 21) * 5**0.5 + E), -6.0, 6.0),
    residual_breakout_confirmation=lambda: _residual_breakout(),
    idiosyncratic_trend_quality=lambda: clip(rsum(resid, 63, 32) / (rstd(resid, 63, 32) * 63**0.5 + E) * (1.0 + clip(ravg(sign(resid), 21, 10), -1.0, 1.0)) * clip(1.0 / (1.0 + absolute(beta(126, 63))), 0.25, 1.0), -6.0, 6.0),
    volatility_transition_alpha=lambda: clip(clip(lag(rmed(tr, 84, 42), 3) / (lag(rmed(tr, 21, 10), 3) + E), 0.25, 5.0) * sqrt(clip(ravg(tr, 8, 4) / (rmed(tr, 21, 10) + E), 0.25, 5.0)) * rsum(resid, 3, 2) / (rstd(resid, 21, 10) * 3**0.5 + E), -6.0, 6.0),
    residual_leadership_persistence=lambda: clip((0.65 * rsum(resid, 21, 10) + 0.35 * rsum(resid, 63, 32) / 3**0.5) / (rstd(resid, 63, 32) * 21**0.5 + E) * (1.0 + clip(2.0 * (ravg(b01(resid > 0.0), 21, 10) - 0.5), -0.5, 0.75)), -6.0, 6.0),
    tight_base_breakout_quality=lambda: clip(clip(rmed(tr, 126, 63) / (rmed(tr, 42, 21) + E), 0.25, 5.0) * sqrt(clip(rmed(tr, 42, 21) / (ravg(tr, 10, 5) + E), 0.25, 5.0)) * clip((c / (lag(rmax(c, 84, 42)) + E) - 1) / (atr(21) / (c + E) + E), -6.0, 6.0) * sqrt(rdv(8, 84)) * (1.0 + cpos), -6.0, 6.0),
    drawdown_repair_velocity=lambda: clip(pos(clip(grown(15) / (15**0.5 * (atr(21) / (c + E) + E)), -6.0, 6.0)) * clip(1.0 + absolute(_drop()), 1.0, 2.0) * (1.0 + cpos), -5.0, 5.0),
    trend_efficiency_stability=lambda: clip(clip(r63 / (rsum(absolute(ret), 63, 32) + E), -2.0, 2.0) * sqrt(clip(rstd(ret, 84, 42) / (rstd(ret, 21, 10) + E), 0.25, 4.0)), -5.0, 5.0),
    upside_volume_asymmetry=lambda: _asymmetry(),
    quiet_accumulation_pressure=lambda: clip(pos(_normed(ret, 10, 5)) * clip(1.0 / clip(ravg(tr, 5, 3) / (rmed(tr, 63, 32) + E), 0.25, 4.0), 0.25, 4.0) * (1.0 + cpos) * sqrt(rdv(10, 84)), -5.0, 5.0),
    volatility_cooldown_momentum=lambda: _cooldown(),
    relative_momentum_spread=lambda: xrank2((0.7 * r21 + 0.3 * r63 / 3**0.5) / (rstd(ret, 42, 21) * 21**0.5 + E)),
    rank_improvement_velocity=lambda: clip(2.0 * (xrank(held(c / (lag(c, 21) + E))) - xrank(lag(r21, 21))), -2.0, 2.0),
    breadth_thrust_participation=lambda: clip(pos(_normed(ret, 5, 3)) * (1.0 + 3.0 * pos(breadth() - lag(breadth(), 5))) * (1.0 + cpos), -5.0, 5.0),
    leader_pullback_accumulation=lambda: clip(pos(xrank2(r63)) * clip(pos(-r5) / (5**0.5 * (atr(21) / (c + E) + E)), 0.0, 4.0) * clip(1.0 / clip(atr(10) / (atr(63) + E), 0.25, 4.0), 0.25, 4.0) * (1.0 + cpos), -5.0, 5.0),
)
add(
    "resilience", False,
    down_market_residual_strength=lambda: _down_strength(),
    downside_capture_inverse=lambda: clip(-rsum(if_(down(), ret, 0.0), 84, 30) / fn("nullif", rsum(absolute(if_(down(), mkt, 0.0)), 84, 30), 0.0), -5.0, 5.0),
    panic_reclaim_strength=lambda: clip(pos(clip(r3 / (3**0.5 * (atr(21) / (c + E) + E)), -6.0, 6.0)) * rmax(b01(mkt < -1.25 * rstd(mkt, 84, 42)), 5, 1) * (1.0 + cpos), -5.0, 5.0),
    drawdown_floor_stability=lambda: clip(1.0 / (1.0 + 8.0 * absolute(rmin(_drop(), 63, 32)) + 30.0 * ravg(absolute(_drop() - lag(_drop())), 42, 21)), 0.0, 1.0),
    weak_breadth_relative_reclaim=lambda: clip(pos(clip(intra / (atr(21) / (c + E) + E), -5.0, 5.0)) * pos(clip((ret - xs("median", ret)) / (rstd(ret, 42, 21) + E), -5.0, 5.0)) * (1.0 + 4.0 * pos(0.5 - breadth())), -5.0, 5.0),
)
add(
    "liquidity", False,
    liquidity_safety_momentum=lambda: clip(clip(rmed(if_(down(), dv), 63, 10) / (rmed(dv, 63, 30) + E), 0.0, 3.0) * sqrt(rdv(10, 84)), 0.0, 5.0),
    relative_volume_sponsorship=lambda: clip(xrank2(rdv(8, 84)) * (1.0 + clip(pos(rsum(ret, 5, 3)) / (rstd(ret, 42, 21) * 5**0.5 + E), 0.0, 3.0)), -4.0, 4.0),
)


def ema(x: X, span: int) -> X:
    """Exponential average without adjustment; weights decay over missing rows too."""
    return X("ema", (held(x),), (span, max(1, span // 2)))


def _fip() -> X:
    grew = held(lag(c, 21) / (lag(c, 252) + E) - 1)
    up, fell = (ravg(b01(x), 231, 126) for x in (lag(ret, 21) > 0.0, lag(ret, 21) < 0.0))
    return grew * clip((1.0 - sign(grew) * (fell - up)) / 2.0, 0.0, 1.0)


def _trends() -> X:
    grew = [grown(n) for n in (21, 63, 126, 252)]
    scaled = [clip(g / (rstd(ret, 63, 32) * n**0.5 + E), -5.0, 5.0) for g, n in zip(grew, (21, 63, 126, 252))]
    return sum(scaled[1:], scaled[0]) / 4.0 * (0.5 + 0.5 * absolute(sum((sign(g) for g in grew[1:]), sign(grew[0])) / 4.0))


def _ou_blend() -> X:
    w = clip((Ou(63).half_life - 2.0) / 40.0, 0.0, 1.0)
    return w * zs(rsum(ret, 21, 10)) + (1.0 - w) * zs(-rsum(ret, 5, 3))


def _disposition() -> X:
    anchor = held((rmax(h, 252, 126) + rmin(l, 252, 126)) / 2.0)
    return ravg(-(c - anchor) / (anchor + E) * (0.5 + 0.5 * b01(ravg(ret, 21, 10) > 0.0)), 63, 31)


def _bvc() -> X:
    f = held(_range_share())
    buy, sell = rsum(f * v, 10, 5), rsum((1.0 - f) * v, 10, 5)
    return (buy - sell) / (buy + sell + E)


def _obv() -> X:
    volume = total("sum", coalesce(sv, 0.0))
    return (ema(volume, 16) - ema(volume, 42)) / (ravg(v, 63, 31) * 42.0 + E)


def _dispersion() -> X:
    spread = ravg(xs("stddev_samp", ret), 21, 10)
    return ravg((ret - xs("avg", ret)) * (spread / (total("avg", spread, 63) + E)), 21, 10)


def _garman() -> X:
    g = 0.5 * ln(h / l) * ln(h / l) - (2 * 0.6931471805599453 - 1) * ln(c / o) * ln(c / o)
    mean = ravg(g, 52, 26)
    return 1.0 / (sqrt(X("clip", (mean,), (E, None)) * 252.0) + E)


def _depth() -> X:
    return held(c / (rmax(c, 126, 63) + E) - 1)


def _drop() -> X:
    return clip(_depth(), -1.0, 0.0)


def _atr_before() -> X:
    return held(atr(14) / (lag(c) + E))


def _atr_now() -> X:
    return held(atr(14) / (c + E))


def _season() -> X:
    years = [held(lag(c, 252 * y) / (lag(c, 252 * y + 21) + E) - 1) for y in range(1, 6)]
    some = sum((coalesce(y, 0.0) for y in years[1:]), coalesce(years[0], 0.0))
    many = sum((if_(X("isnull", (y,)), 0.0, 1.0) for y in years[1:]), if_(X("isnull", (years[0],)), 0.0, 1.0))
    return some / fn("nullif", many, 0.0)


def _channel() -> X:
    top, low = lag(rmax(h, 63, 32)), lag(rmin(l, 63, 32))
    a = fn("nullif", atr(14), 0.0)
    return clip(1.5 * clip((c - low) / (top - low + E) - 0.5, -1.5, 1.5) + 0.7 * clip((c - top) / a, -5.0, 5.0) + 0.3 * clip((c - low) / a, -5.0, 5.0), -6.0, 6.0)


def _rejection() -> X:
    top, low, a = lag(rmax(h, 21, 10)), lag(rmin(l, 21, 10)), fn("nullif", atr(14), 0.0)
    return clip(clip((low - l) / a, 0.0, 4.0) * cpos - clip((h - top) / a, 0.0, 4.0) * pos(-cloc), -4.0, 4.0)


def _exhaustion() -> X:
    s, w = clip(r5 / (5**0.5 * (_atr_now() + E)), -6.0, 6.0), sqrt(rdv(5, 63))
    return clip(pos(-s) * cpos * w - pos(s) * pos(-cloc) * w, -5.0, 5.0)


def _reclaim() -> X:
    floor, a = lag(rmin(l, 21, 10)), fn("nullif", atr(14), 0.0)
    return clip(clip((floor - l) / a, 0.0, 5.0) * pos(clip((c - floor) / a, -5.0, 5.0)) * (1.0 + cpos), -5.0, 5.0)


def _pullback() -> X:
    ma10, ma21, ma63, a = ravg(c, 10, 5), ravg(c, 21, 10), ravg(c, 63, 32), fn("nullif", atr(14), 0.0)
    trend = clip((ma21 / (ma63 + E) - 1) / (_atr_now() + E), -4.0, 4.0)
    return clip(pos(trend) * clip((ma21 - rmin(l, 8, 4)) / a, 0.0, 4.0) * pos(clip((c - ma10) / a, -4.0, 4.0)) * (1.0 + cpos), -5.0, 5.0)


def _residual_breakout() -> X:
    # growth of one: the exponential of the sum of logs, with the sign of the number of negative steps
    step = held(1.0 + coalesce(resid, 0.0))
    index = held(fn("exp", total("sum", ln(X("clip", (held(absolute(step)),), (1e-300, None))))) * (1.0 - 2.0 * fn("mod", total("sum", b01(step < 0.0)), 2.0)))
    return clip(clip((index / (lag(rmax(index, 63, 32)) + E) - 1) / (rstd(coalesce(resid, 0.0), 42, 21) + E), -6.0, 6.0) * sqrt(rdv(5, 63)), -6.0, 6.0)


def _asymmetry() -> X:
    up, fell = rsum(if_(ret > 0.0, dv, 0.0), 21, 10), rsum(if_(ret < 0.0, dv, 0.0), 21, 10)
    return clip((up - fell) / (up + fell + E) * sqrt(rdv(5, 63)), -4.0, 4.0)


def _cooldown() -> X:
    short, long = ravg(tr, 10, 5), rmed(tr, 63, 32)
    return clip(sqrt(clip(lag(short, 5) / (lag(long, 5) + E), 0.25, 6.0)) * sqrt(clip(long / (short + E), 0.25, 6.0)) * pos(_normed(ret, 10, 5)), -5.0, 5.0)


def _down_strength() -> X:
    n = rsum(b01(down()), 63, 1)
    enough = n >= 7.0
    strength = if_(enough, rsum(if_(down(), resid, 0.0), 63, 7) / n, ravg(resid, 63, 31))
    return clip(strength / (rstd(resid, 63, 31) + E) * sqrt(if_(enough, n, 63.0)), -6.0, 6.0)
