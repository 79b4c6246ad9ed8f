"""Named strategies and blends: which factors each looks at, how its book is built, and how long it is held.

A registry is rows: ``factor_rows`` and ``parameter_rows`` are tables that plans join, so that any number of strategies is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from crosswind.operators.construct import Blend, Book
from crosswind.operators.factors import REGISTRY

# Groups of factors, and of each strategy its factors, parameters, and least days held and between rebalances.
DEFENSIVE = ("inv_vol", "inv_downside", "low_beta", "beta_stability", "amihud_inv", "vol_of_vol_inv", "skew_pref", "kurtosis_inv", "cross_sectional_dispersion", "max_lottery", "turnover_vol_inv", "inv_idio", "low_corr", "liquidity", "gk_inv_vol")
MOMENTUM = (
    "mom_12_1", "resid_mom", "resid_mom_short", "trend_consistency", "prox_52w_high", "slope_ema", "breakout", "mom_accel", "momentum_quality", "momentum_persistence", "overnight_bias", "attention_momentum", "anchoring_bias", "efficiency_ratio", "capm_alpha", "fip_momentum",
    "intermediate_momentum",
)
MEAN_REVERSION = ("srev", "resid_srev", "ou_zscore", "ou_predicted_return", "ou_mom_blend", "mean_reversion_speed", "disposition_alpha")
FLOW = ("ofi_med", "mtf_ofi_alignment", "vpin_inv", "kyle_lambda_inv", "bvc_imbalance", "exec_quality", "flow_persistence", "obv_trend")
RESILIENCE = ("downside_beta_resilience", "drawdown_resilience", "gap_resilience", "correlation_shock_resilience", "beta_asymmetry")
TREND = ("multi_horizon_trend", "residual_trend_tstat", "volume_confirmed_breakout", "vol_scaled_momentum", "liquidity_momentum")
RESIDUAL = ("residual_trend_tstat", "resid_mom", "resid_mom_short", "capm_alpha", "resid_srev", "ou_predicted_return", "low_corr", "inv_idio")
PRICE_ACTION = ("channel_pressure", "compression_thrust", "gap_continuation", "range_participation", "range_rejection")
TAPE = ("liquidity_squeeze_breakout", "pullback_reclaim", "gap_reversal_pressure", "opening_drive_continuation", "exhaustion_reversal", "range_volume_acceleration")
CATALYST = ("residual_momentum_acceleration", "residual_breakout_confirmation", "downside_absorption_reversal", "failed_breakdown_reclaim", "idiosyncratic_trend_quality", "volatility_transition_alpha")
LEADERSHIP = ("residual_leadership_persistence", "tight_base_breakout_quality", "drawdown_repair_velocity", "trend_efficiency_stability", "upside_volume_asymmetry", "quiet_accumulation_pressure")
DOWNSIDE = ("down_market_residual_strength", "downside_capture_inverse", "panic_reclaim_strength", "drawdown_floor_stability", "liquidity_safety_momentum", "volatility_cooldown_momentum")
ROTATION = ("relative_momentum_spread", "rank_improvement_velocity", "relative_volume_sponsorship", "breadth_thrust_participation", "leader_pullback_accumulation", "weak_breadth_relative_reclaim")
CONTROLS = ("gk_inv_vol", "inv_idio", "low_corr", "liquidity")
LASTING = ("prox_52w_high", "intermediate_momentum", "fip_momentum", "momentum_quality", "trend_consistency", "efficiency_ratio", "liquidity", "liquidity_momentum", "gk_inv_vol", "turnover_vol_inv", "low_corr", "inv_idio")


@dataclass(frozen=True)
class Strategy:
    name: str
    factors: tuple[str, ...]
    book: Book
    target_vol: float = 0.18
    bps: float = 3.0
    hold: int = 2
    every: int = 1
    learned: bool = False
    mature: bool = True

    def __post_init__(self):
        if unknown := sorted(set(self.factors) - set(REGISTRY)) or (not self.factors and ["none"]):
            raise ValueError(f"{self.name} looks at unknown factors: {unknown}")
        if self.every < 1 or self.hold < 0:
            raise ValueError(f"{self.name} has no cadence")


def _of(name: str, *factors: str, seats: tuple[int, int, int] = (20, 15, 30), smooth: int = 4, speed: float = 0.40, band: float = 0.04, mode: str = "score", most: float = 0.15, least: float = 0.005, slope: float = 4.0, cluster: float = 0.40, **more) -> Strategy:
    """Each factor once, in the order given; seats are the usual, least and most number."""
    return Strategy(name, tuple(dict.fromkeys(factors)), Book(seats[0], seats[1], seats[2], slope, most, least, smooth=smooth, speed=speed, band=band, mode=mode, cluster_cap=cluster), **more)


STRATEGIES: dict[str, Strategy] = {s.name: s for s in (
    _of("neural_alpha", *DEFENSIVE, *MOMENTUM, *MEAN_REVERSION, *FLOW, seats=(20, 15, 25), speed=0.35, target_vol=0.17, hold=3, learned=True),
    _of("hybrid_alpha", *DEFENSIVE, *MOMENTUM, *MEAN_REVERSION, *FLOW, band=0.045, target_vol=0.16, hold=3),
    _of("concentrated", *DEFENSIVE, *MOMENTUM, *MEAN_REVERSION, *FLOW, seats=(9, 7, 10), most=0.12, least=0.02, smooth=5, speed=0.30, band=0.06, target_vol=0.17, cluster=0.30, hold=5),
    _of("momentum_quality", *DEFENSIVE[:8], *MOMENTUM, seats=(18, 15, 24), smooth=5, speed=0.32, band=0.05, target_vol=0.17, hold=4),
    _of("ou_mean_reversion", *DEFENSIVE[:8], *MEAN_REVERSION, seats=(22, 18, 28), smooth=2, speed=0.55, band=0.025, target_vol=0.12, bps=4.0, hold=1),
    _of("defensive_alpha", *DEFENSIVE, *RESILIENCE, "mom_12_1", "resid_mom", "trend_consistency", "momentum_quality", "prox_52w_high", "capm_alpha", seats=(25, 20, 30), most=0.10, smooth=6, speed=0.28, band=0.06, target_vol=0.13, every=2, hold=5),
    _of("low_turnover", *DEFENSIVE, "mom_12_1", "resid_mom", "trend_consistency", "prox_52w_high", "momentum_quality", "capm_alpha", "ou_mom_blend", seats=(25, 20, 30), smooth=8, speed=0.20, band=0.08, target_vol=0.15, every=3, hold=7),
    _of("alpha_beta", *DEFENSIVE, *RESILIENCE, *TREND, "mom_12_1", "fip_momentum", "intermediate_momentum", "capm_alpha", seats=(18, 14, 24), mode="blend", most=0.12, cluster=0.32, speed=0.35, hold=3),
    _of("crash_resilient_momentum", *TREND, *RESILIENCE, "mom_12_1", "fip_momentum", "intermediate_momentum", "momentum_quality", "trend_consistency", "prox_52w_high", *CONTROLS, seats=(20, 16, 26), mode="blend", most=0.10, cluster=0.30, smooth=5, speed=0.30, band=0.05, target_vol=0.15, hold=4),
    _of("residual_alpha", *RESIDUAL, *RESILIENCE, "liquidity", "gk_inv_vol", "turnover_vol_inv", "efficiency_ratio", seats=(22, 16, 28), mode="hrp", most=0.09, cluster=0.28, speed=0.35, target_vol=0.14, hold=3),
    _of("dispersion_alpha", "cross_sectional_dispersion", "residual_trend_tstat", "resid_mom", "resid_srev", "ou_predicted_return", "low_corr", "inv_idio", "liquidity", "drawdown_resilience", "beta_asymmetry", seats=(24, 14, 30), slope=6.0, mode="blend", most=0.09, cluster=0.28, smooth=3, band=0.035, target_vol=0.13),
    _of("flow_alpha", *DEFENSIVE[:5], *FLOW, "resid_mom_short", "efficiency_ratio", "attention_momentum", smooth=2, speed=0.50, band=0.03, target_vol=0.12, bps=5.0, hold=1, mature=False),
    _of("behavioral_alpha", "attention_momentum", "disposition_alpha", "anchoring_bias", "overnight_bias", "max_lottery", "skew_pref", "kurtosis_inv", "efficiency_ratio", "mean_reversion_speed", "vol_of_vol_inv", "momentum_quality", "momentum_persistence", "cross_sectional_dispersion", "liquidity_momentum", "inv_vol", "inv_idio", "low_corr", "liquidity", seats=(20, 16, 26), smooth=3, target_vol=0.15),
    _of("composer_sharpe", *DEFENSIVE, *MOMENTUM, "srev", "resid_srev", "ou_zscore", "ou_predicted_return", "mean_reversion_speed", "vol_scaled_momentum", seats=(25, 20, 30), mode="hrp", most=0.10, cluster=0.30, speed=0.33, hold=3, learned=True),
    _of("multi_timeframe_trend", *TREND, "mom_12_1", "fip_momentum", "intermediate_momentum", "resid_mom", "trend_consistency", "slope_ema", "efficiency_ratio", *CONTROLS, seats=(20, 16, 26), mode="blend", most=0.11, cluster=0.32, speed=0.34, band=0.045, target_vol=0.17, hold=4),
    _of("technical_alpha", "ma_cloud", "vol_breakout", "calm_flow", "vol_surprise", "idio_tail_risk", "breakout", "slope_ema", "prox_52w_high", "mom_accel", "efficiency_ratio", "inv_vol", *CONTROLS, seats=(20, 16, 26), mode="blend", most=0.11, cluster=0.32, speed=0.35, band=0.045, target_vol=0.16, hold=3),
    _of("range_reversal", "ou_zscore", "ou_zscore_short", "ou_halflife_signal", "ou_predicted_return", "srev", "lrev", "resid_srev", "mean_reversion_speed", "disposition_alpha", "hloc_close_position", "inv_vol", *CONTROLS, "turnover_vol_inv", seats=(22, 18, 28), smooth=2, speed=0.55, band=0.025, target_vol=0.12, bps=4.0, hold=1),
    _of("frontier_price_action", *PRICE_ACTION, *TREND, *RESILIENCE, "ma_cloud", "vol_breakout", "hloc_close_position", "efficiency_ratio", *CONTROLS, seats=(18, 14, 24), mode="blend", most=0.10, cluster=0.30, smooth=3, speed=0.42, band=0.035, target_vol=0.16),
    _of("tape_acceleration", *TAPE, *TREND, *RESILIENCE, "channel_pressure", "compression_thrust", "range_participation", "range_rejection", "efficiency_ratio", *CONTROLS, "turnover_vol_inv", seats=(20, 16, 28), mode="blend", most=0.095, cluster=0.30, smooth=3, speed=0.44, band=0.032, target_vol=0.155, bps=4.0),
    _of("alpha_catalyst", *CATALYST, *TAPE, *RESIDUAL, *TREND, *RESILIENCE, "channel_pressure", "compression_thrust", "range_participation", "range_rejection", "efficiency_ratio", "gk_inv_vol", "turnover_vol_inv", "liquidity", "momentum_quality", "trend_consistency", seats=(18, 14, 26), mode="blend", most=0.09, cluster=0.28, smooth=3, speed=0.46, band=0.030, target_vol=0.15, bps=4.5),
    _of("leadership_quality", *LEADERSHIP, *CATALYST, *TAPE, *RESIDUAL, *TREND, *RESILIENCE, *LASTING, seats=(18, 14, 24), mode="blend", most=0.085, cluster=0.26, smooth=5, speed=0.38, target_vol=0.145, bps=4.0, hold=4),
    _of("downside_resilience", *DOWNSIDE, *RESILIENCE, *DEFENSIVE, *RESIDUAL, *TREND, *CATALYST, *LEADERSHIP, seats=(16, 12, 22), mode="blend", most=0.075, cluster=0.24, smooth=6, speed=0.34, band=0.045, target_vol=0.12, bps=4.0, hold=5),
    _of("rotation_breadth", *ROTATION, *TAPE, *CATALYST, *LEADERSHIP, *RESIDUAL, *TREND, *RESILIENCE, *LASTING, seats=(20, 16, 28), mode="blend", most=0.085, cluster=0.27, speed=0.42, band=0.034, target_vol=0.155, bps=4.2, hold=3),
)}

BLENDS: dict[str, Blend] = {b.name: b for b in (
    Blend("flagship_shield", (("concentrated", 0.7), ("defensive_alpha", 0.3))),
    Blend("trend_reversion", (("momentum_quality", 0.5), ("ou_mean_reversion", 0.5))),
    Blend("all_weather", (("hybrid_alpha", 0.4), ("defensive_alpha", 0.3), ("low_turnover", 0.3))),
    Blend("adaptive", (("concentrated", 0.25), ("momentum_quality", 0.25), ("ou_mean_reversion", 0.25), ("defensive_alpha", 0.25)), "inverse_vol", least=0.1, most=0.5),
    Blend("institutional_alpha", (("alpha_beta", 0.25), ("crash_resilient_momentum", 0.25), ("residual_alpha", 0.25), ("defensive_alpha", 0.25)), "alpha_risk", least=0.08, most=0.5, alpha=0.4),
    Blend("opportunity_stack", (("concentrated", 0.25), ("dispersion_alpha", 0.25), ("ou_mean_reversion", 0.25), ("low_turnover", 0.25)), "alpha_risk", least=0.08, most=0.5, alpha=0.3),
)}


def factor_rows() -> list[tuple[str, str]]:
    return [(s.name, f) for s in STRATEGIES.values() for f in s.factors]
