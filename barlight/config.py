"""Parameters of the jobs; the defaults are those of 5-minute bars."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    bar_seconds: int = 300
    horizon: int = 3
    threshold_window: int = 2880
    min_history: int = 672
    monitor_window: int = 2880
    tail: float = 0.01
    signal_cost: float = 1e-4
    turnover_cost: float = 5e-5
    volatility_floor: float = 1e-6
    clip: tuple[float, float] = (0.005, 0.995)

    @property
    def horizon_seconds(self) -> int:
        return self.horizon * self.bar_seconds

    @property
    def periods_per_year(self) -> float:
        """Rows a year after thinning to one a horizon: 35,040 for three 5-minute bars."""
        return 365 * 86_400 / self.horizon_seconds


#: Daily bars of the test tables: years of history, but few rows a series.
DAILY = Config(bar_seconds=86_400, threshold_window=480, min_history=112, monitor_window=96)
HALF_HOUR = Config(bar_seconds=1_800)
