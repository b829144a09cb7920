"""Thresholds of every job, as plain dataclasses of literals.

Fixed values: the defaults below decide which rows qualify, so they are stated
as they must be for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SeriesParams:
    """How a long series is cut for parallel work; never changes a result."""

    chunk_days: int = 1024  # calendar span of one chunk (daily bars)
    block_rows: int = 4096  # rows of one block once positions are known


@dataclass(frozen=True)
class ScanParams:
    min_price: float = 2.0
    min_avg_volume: float = 30_000.0
    volume_bars: int = 20
    bb_period: int = 20
    bb_std: float = 2.0
    bb_tolerance: float = 0.005
    rsi_period: int = 14
    rsi_oversold: float = 30.0
    support_lookback: int = 250
    support_cluster: float = 0.01
    support_touches: int = 2
    support_above: float = 0.015
    support_below: float = 0.005
    wedge_lookback: int = 120
    wedge_min_bars: int = 20
    wedge_pivots: int = 4
    wedge_margin: float = 0.005
    pivot_order: int = 3
    signal_score: int = 3
    hot_score: int = 2
    hot_cap: int = 300
    chart_bars: int = 80
    chart_min_bars: int = 25

    @property
    def tail_bars(self) -> int:
        return max(self.support_lookback, self.wedge_lookback, self.chart_bars + self.bb_period,
                   self.volume_bars)


@dataclass(frozen=True)
class CallTier:
    """One tier of the best-call predicate."""

    delta_min: float
    delta_max: float
    dte_min: int
    dte_max: int
    volume_min: int
    oi_min: int
    iv_below: float
    spread_below: float


@dataclass(frozen=True)
class ContractParams:
    window_days: int = 91  # 13 weeks
    max_expiries: int = 6
    top_n: int = 3
    min_activity: int = 20
    rate: float = 0.045
    cheap_contract_price: float = 50.0
    strict: CallTier = CallTier(0.60, 0.80, 1, 90, 100, 500, 0.40, 0.10)
    relaxed: CallTier = CallTier(0.60, 0.80, 1, 90, 50, 500, 0.50, 0.10)
    bottom_max_premium: float = 3.0
    bottom_min_dte: int = 30
    bottom_max_dte: int = 365
    bottom_atm: float = 0.02
    bottom_max_expiries: int = 12
    bottom_symbols: int = 40
    bottom_per_symbol: int = 3


@dataclass(frozen=True)
class ReboundParams:
    history_bars: int = 252
    low_window: int = 252
    low_min_bars: int = 60
    rsi_period: int = 14
    dip_rsi: float = 35.0
    near_low: float = 0.10
    sma_bars: int = 50
    change_bars: int = 20
    first_bar: int = 60
    horizon: int = 30
    gap: int = 10
    min_gain: float = 0.08
    min_episodes: int = 3
    min_rate: float = 0.60


@dataclass(frozen=True)
class ScreenParams:
    option_types: tuple[str, ...] = ("call", "put")
    min_dte: int = 7
    max_dte: int = 45
    min_volume: int = 30
    min_open_interest: int = 200
    max_spread_pct: float = 0.40
    iv_min: float = 0.15
    iv_max: float = 0.60
    delta_min: float = 0.30
    delta_max: float = 0.90
    max_theta_pct: float | None = 0.05
    rate: float = 0.045
    dividend_yield: float = 0.0
    positive_bid: bool = True


# The two default sets of the screener: as a library, and on the command line.
SCREEN_PRESETS = {
    "library": ScreenParams(),
    "cli": ScreenParams(min_dte=1, max_dte=45, min_volume=100, min_open_interest=500,
                        max_spread_pct=0.10, iv_min=0.15, iv_max=1.00,
                        delta_min=0.30, delta_max=0.70, max_theta_pct=0.05),
}


@dataclass(frozen=True)
class PerformanceParams:
    horizons_hours: tuple[int, ...] = (24, 72)
    check_seconds: int = 1800
    max_attempts: int = 8
    min_sample: int = 5
    benchmark: str = "SPY"


@dataclass(frozen=True)
class DigestParams:
    headlines: int = 5
    messages: int = 20
    max_chars: int = 500


@dataclass(frozen=True)
class SessionParams:
    pause_weekends_and_holidays: bool = True
    regular_hours_only: bool = True
    daily_bars: bool = False  # bars are stamped with their exchange date, at midnight
