"""Settings of the analysis with their defaults, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


def _check(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class ProfileConfig:
    num_bins: int = 100
    bin_size: float | None = None
    bin_mode: str = "fixed"
    atr_period: int = 14
    atr_bin_fraction: float = 0.25
    min_bins: int = 20
    max_bins: int = 500
    value_area_pct: float = 0.70
    distribution: str = "uniform"
    hvn_prominence: float = 0.10
    node_min_distance: int = 2
    smoothing_sigma: float = 1.0
    max_nodes: int = 5

    def __post_init__(self):
        _check(self.num_bins >= 1, "num_bins must be at least 1")
        _check(self.bin_size is None or self.bin_size > 0, "bin_size must be above 0")
        _check(self.bin_mode in ("fixed", "auto"), "bin_mode must be fixed or auto")
        _check(self.atr_period >= 1 and self.atr_bin_fraction > 0, "atr_period must be at least 1, atr_bin_fraction above 0")
        _check(1 <= self.min_bins <= self.max_bins, "bins must lie in 1 <= min_bins <= max_bins")
        _check(0 < self.value_area_pct <= 1, "value_area_pct must be in (0, 1]")
        _check(self.distribution in ("uniform", "typical"), "distribution must be uniform or typical")
        _check(0 <= self.hvn_prominence <= 1, "hvn_prominence must be in [0, 1]")
        _check(self.node_min_distance >= 1 and self.smoothing_sigma >= 0 and self.max_nodes >= 0, "node settings must not be below their least")


@dataclass(frozen=True)
class QuietConfig:
    atr_period: int = 14
    volume_window: int = 20
    range_window: int = 20
    baseline_window: int = 100
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    quiet_threshold: float = 60.0
    atr_method: str = "wilder"
    min_bars: int = 30

    def __post_init__(self):
        _check(min(self.atr_period, self.volume_window, self.range_window, self.baseline_window) >= 2, "windows must be at least 2")
        _check(len(self.weights) == 3 and min(self.weights) >= 0 and sum(self.weights) > 0, "three weights, none below 0, not all 0")
        _check(0 <= self.quiet_threshold <= 100, "quiet_threshold must be in [0, 100]")
        _check(self.atr_method in ("wilder", "sma"), "atr_method must be wilder or sma")


@dataclass(frozen=True)
class PatternConfig:
    volume_ma_window: int = 20
    baseline_window: int = 60
    dryup_factor: float = 0.5
    dryup_min_run: int = 3
    climax_volume_factor: float = 2.5
    climax_range_factor: float = 1.5
    atr_period: int = 14
    divergence_window: int = 20
    divergence_eps: float = 5e-4
    divergence_min_run: int = 3
    accumulation_flat_atr: float = 2.0
    accumulation_min_run: int = 5
    level_tolerance_atr: float = 0.5
    min_bars: int = 30

    def __post_init__(self):
        _check(min(self.volume_ma_window, self.baseline_window, self.divergence_window, self.atr_period) >= 2, "windows must be at least 2")
        _check(min(self.dryup_min_run, self.divergence_min_run, self.accumulation_min_run) >= 1, "runs must be at least 1")
        _check(0 < self.dryup_factor < 1, "dryup_factor must be in (0, 1)")
        _check(min(self.climax_volume_factor, self.climax_range_factor, self.accumulation_flat_atr) > 0, "factors must be above 0")
        _check(self.divergence_eps >= 0 and self.level_tolerance_atr >= 0, "tolerances must not be below 0")


@dataclass(frozen=True)
class ConfluenceConfig:
    weights: dict[str, float] = field(default_factory=lambda: {"value_area": 1.0, "key_level": 1.0, "quiet": 1.5, "patterns": 1.5})
    neutral_band: float = 10.0
    node_tolerance_atr: float = 0.5
    pattern_recency: int = 10
    atr_period: int = 14

    def __post_init__(self):
        _check(set(self.weights) == {"value_area", "key_level", "quiet", "patterns"}, "a weight for each of the four components")
        _check(min(self.weights.values()) >= 0 and sum(self.weights.values()) > 0, "weights must not be below 0, nor all 0")
        _check(0 <= self.neutral_band <= 100 and self.node_tolerance_atr > 0, "neutral_band must be in [0, 100], node_tolerance_atr above 0")
        _check(self.pattern_recency >= 0 and self.atr_period >= 1, "pattern_recency must not be below 0, atr_period at least 1")


@dataclass(frozen=True)
class SignalConfig:
    style: str = "reversion"
    min_quality: float = 55.0
    min_abs_bias: float = 15.0
    require_quiet: bool = False
    min_quiet_score: float = 60.0
    min_rr: float = 1.5
    atr_stop_mult: float = 1.5
    stop_buffer_atr: float = 0.25
    breakout_buffer_atr: float = 0.10
    target_rr: float = 2.0
    risk_fraction: float = 0.01
    account_equity: float = 10_000.0

    def __post_init__(self):
        _check(self.style in ("reversion", "breakout"), "style must be reversion or breakout")
        _check(0 < self.risk_fraction <= 1, "risk_fraction must be in (0, 1]")
        _check(min(self.min_rr, self.atr_stop_mult, self.target_rr, self.account_equity) > 0, "min_rr, atr_stop_mult, target_rr and account_equity must be above 0")
        _check(min(self.stop_buffer_atr, self.breakout_buffer_atr) >= 0, "buffers must not be below 0")

    def gate(self) -> dict:
        """As decisions.signals takes it."""
        return {"least_quality": self.min_quality, "least_bias": self.min_abs_bias, "least_quiet": self.min_quiet_score if self.require_quiet else None, "least_rr": self.min_rr, "budget": self.account_equity * self.risk_fraction}


@dataclass(frozen=True)
class SplitConfig:
    n_groups: int = 6
    n_test_groups: int = 2
    purge: int = 0
    embargo_pct: float = 0.0

    def __post_init__(self):
        _check(self.n_groups >= 2 and 1 <= self.n_test_groups < self.n_groups, "1 <= n_test_groups < n_groups")
        _check(self.purge >= 0 and 0 <= self.embargo_pct < 1, "purge must not be below 0, embargo_pct in [0, 1)")
