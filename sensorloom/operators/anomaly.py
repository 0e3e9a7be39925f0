"""Scoring of each sensor's newest reading against the readings before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.time import Instant
from sensorloom.operators.history import recent_readings
from sensorloom.settings import DEFAULTS, Settings

# A detector maps the recent readings (sensor_id, timestamp, value, rank; rank 1 is the
# newest) to one row per sensor: sensor_id, is_anomaly, z_score, current_value, mean, std.
Detector = Callable[[DataFrame], DataFrame]

# Fixed values of the z-score detector.
LEAST_READINGS = 10
LEAST_HISTORY = 5
LEAST_SPREAD = 1e-9


def zscore_detector(window: int = DEFAULTS.anomaly_window, threshold: float = DEFAULTS.anomaly_z) -> Detector:
    def detect(recent: DataFrame) -> DataFrame:
        is_history = F.col("rank").between(2, window + 1)
        history = F.when(is_history, F.col("value"))
        scored = recent.groupBy("sensor_id").agg(
            F.count(F.lit(1)).alias("readings"),
            F.count(history).alias("history"),
            F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("current"),
            F.avg(history).alias("m"),
            F.stddev_pop(history).alias("s"),
        )
        enough = F.col("readings") >= LEAST_READINGS
        usable = enough & (F.col("history") >= LEAST_HISTORY)
        z = F.when(F.col("s") < LEAST_SPREAD, 0.0).otherwise((F.col("current") - F.col("m")) / F.nullif("s", F.lit(0.0)))
        return scored.select(
            "sensor_id",
            F.coalesce(usable & (F.abs(z) > threshold), F.lit(False)).alias("is_anomaly"),
            F.when(usable, z).alias("z_score"),
            F.when(enough, F.col("current")).alias("current_value"),
            F.when(usable, F.col("m")).alias("mean"),
            F.when(usable, F.col("s")).alias("std"),
        )

    return detect


def anomaly_latest(
    readings: DataFrame,
    as_of: Instant,
    settings: Settings = DEFAULTS,
    detector: Detector | None = None,
) -> DataFrame:
    """One verdict per sensor with a reading since the cutoff.

    The fetch holds ``anomaly_window`` readings including the newest, so the built-in
    detector compares with one fewer.
    """
    detect = detector or zscore_detector(settings.anomaly_window, settings.anomaly_z)
    return detect(recent_readings(readings, as_of, settings.anomaly_max_age_hours, settings.anomaly_window))
