"""Tunables of every operator, with the defaults a deployment starts from."""

from __future__ import annotations

from dataclasses import dataclass, field

# Physically possible range per sensor type, both ends allowed.
IMPOSSIBLE_BOUNDS: dict[str, tuple[float, float]] = {
    "temperature": (-50.0, 80.0),
    "humidity": (0.0, 100.0),
    "soil_moisture": (0.0, 100.0),
    "light": (0.0, 200000.0),
    "co2": (0.0, 10000.0),
    "irrigation": (0.0, 1000.0),
}

# The raw-layer quality gate only looks at these four types.
GATED_TYPES = ("temperature", "humidity", "soil_moisture", "co2")

# Expected yield per crop in kg/m2.
YIELD_BASELINES: dict[str, float] = {
    "tomato": 4.8,
    "cucumber": 3.6,
    "lettuce": 2.7,
    "pepper": 3.2,
}


@dataclass(frozen=True)
class Settings:
    overview_window_hours: int = 24
    warning_tolerance_percent: float = 15.0

    co2_min_ppm: float = 400.0
    co2_max_ppm: float = 1500.0

    rolling_rows: int = 59
    rolling_z: float = 5.0

    anomaly_window: int = 60
    anomaly_z: float = 4.0
    anomaly_max_age_hours: int = 24

    recent_hours: int = 1
    recent_rows: int = 30
    sustained_window: int = 5
    yield_risk_ratio: float = 0.85
    yield_baselines: dict[str, float] = field(default_factory=lambda: dict(YIELD_BASELINES))

    reporting_minutes: int = 5
    freshness_minutes: int = 15
    gap_hours: int = 1


DEFAULTS = Settings()
