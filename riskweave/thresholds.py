"""Every cut the operators use, in one place, with the standard defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from riskweave import fixed_values as fv


@dataclass(frozen=True)
class Thresholds:
    # event windows
    short_window_days: int = 30
    long_window_days: int = 90
    baseline_window_days: int = 365
    travel_gap_hours: float = 3.0
    bulk_download_min: int = 100            # strictly more than this fires
    # rules
    stale_days: int = 30
    utilization_floor: float = 0.20
    creep_changes: int = 3
    sprawl_systems: int = 5
    excessive_anomaly_rate: float = 0.30
    lateral_resources: int = 20
    lateral_multiplier: float = 3.0
    bulk_off_hours_pct: float = 0.50
    # context
    temp_elevation_min: int = 1
    temp_elevation_max: int | None = None   # None keeps the open-ended rule
    # baselines
    month_end_day: int = 28
    top_hours: int = 8
    top_resources: int = 10
    epsilon: float = 1e-8
    # scoring
    amplifier: float = 1.20
    amplifier_min_rules: int = 3
    rule_weights: dict = field(default_factory=lambda: dict(fv.RULE_WEIGHTS))


DEFAULTS = Thresholds()
