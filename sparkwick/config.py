"""Scalar settings (turned into literals when a plan is built) and the physical layout."""

from __future__ import annotations

from dataclasses import dataclass, replace

SERIES_KEYS = ("symbol", "timeframe")


@dataclass(frozen=True)
class Layout:
    """How the rows of a candle series are spread over tasks.

    ``chunk`` bars of one series share a window partition; ``back``/``fwd`` neighbour bars are
    copied into it so that finite frames are complete. ``bounded`` says that every group of
    ``keys`` is known to be short (at most ``chunk`` bars), so one group is one window partition.
    ``single`` says that this was checked, so that no recurrence has to restart inside a group.
    """

    keys: tuple[str, ...] = SERIES_KEYS
    chunk: int = 1024
    back: int = 64
    fwd: int = 16
    bounded: bool = False
    single: bool = False

    @property
    def window_keys(self) -> list[str]:
        return list(self.keys) if self.bounded else [*self.keys, "chunk"]

    def per(self, *extra: str) -> "Layout":
        """The layout of short groups below the series, such as one row set per decision bar."""
        return replace(self, keys=(*self.keys, *extra), bounded=True, single=False)


# The defaults below define the results.
@dataclass(frozen=True)
class AnalysisConfig:
    swing_window: int = 5
    trend_swing_lookback: int = 6
    sideways_threshold: float = 0.25
    zone_merge_atr: float = 0.5
    max_zones: int = 10
    equal_level_atr: float = 0.15
    sweep_close_back_ratio: float = 0.5
    fvg_min_atr: float = 0.1
    ob_displacement_atr: float = 1.5
    ob_max_age: int = 500
    ob_horizon: int = 3
    ema_periods: tuple[int, ...] = (20, 50, 100, 200)
    sma_period: int = 20
    atr_period: int = 14
    rsi_period: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    adx_period: int = 14
    momentum_period: int = 10
    roc_period: int = 10
    cci_period: int = 20
    stoch_k: int = 14
    stoch_d: int = 3
    williams_period: int = 14
    bollinger_period: int = 20
    bollinger_std: float = 2.0
    rolling_window: int = 20
    volume_ma_period: int = 20
    volume_spike_multiple: float = 2.0
    hist_vol_window: int = 20
    expansion_ratio: float = 1.5
    compression_ratio: float = 0.66
    spread_window: int = 20
    spread_spike_multiple: float = 2.0
    session_sydney: tuple[int, int] = (21, 6)
    session_asian: tuple[int, int] = (0, 9)
    session_london: tuple[int, int] = (7, 16)
    session_newyork: tuple[int, int] = (12, 21)


DEFAULT = AnalysisConfig()
DEFAULT_LAYOUT = Layout()
