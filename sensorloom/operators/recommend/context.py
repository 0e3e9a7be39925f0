"""What the rules look at: one wide row per zone, open alerts and predicted yields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.numeric import exact_mean
from sensorloom.functions.time import Instant
from sensorloom.operators.history import recent_readings
from sensorloom.schemas import ACTIVE_ALERT_STATUSES, SENSOR_TYPES
from sensorloom.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Context:
    zones: DataFrame  # zone_wide_view, plus predicted_yield when a model is at hand
    open_alerts: DataFrame
    model_version: str = "unknown"
    settings: Settings = DEFAULTS


def sensor_view(readings: DataFrame, as_of: Instant, settings: Settings = DEFAULTS) -> DataFrame:
    """Per sensor: current value and a digest of its newest ``sustained_window`` readings."""
    recent = recent_readings(readings, as_of, settings.recent_hours, settings.recent_rows)
    last = f"rank <= {settings.sustained_window}"
    in_window = f"if({last}, value, NULL)"
    aggregates = {
        "current_value": "max(if(rank = 1, value, NULL))",
        "last_timestamp": "max(timestamp)",
        "window_count": f"count({in_window})",
        "window_min": f"min({in_window})",
        "window_max": f"max({in_window})",
        "window_avg": exact_mean(in_window),
        "window_start": f"min(if({last}, timestamp, NULL))",
    }
    return recent.groupBy("sensor_id").agg(*[F.expr(f"{text} AS {name}") for name, text in aggregates.items()])


def _of_type(kind: str, column: str, name: str) -> Column:
    return F.expr(f"max(if(sensor_type = '{kind}', {column}, NULL)) AS {kind}_{name}")


def zone_wide_view(
    zones: DataFrame, sensors: DataFrame, readings: DataFrame, as_of: Instant, settings: Settings = DEFAULTS
) -> DataFrame:
    """Every zone with one column set per sensor type; a zone has at most one of a type."""
    views = sensors.select(F.col("id").alias("sensor_id"), "zone_id", "sensor_type").join(
        sensor_view(readings, as_of, settings), "sensor_id", "left"
    )
    per_type = [
        _of_type(kind, column, name)
        for kind in SENSOR_TYPES
        for name, column in (("sensor_id", "sensor_id"), ("value", "current_value"), ("at", "last_timestamp"))
    ]
    digest = [
        _of_type("temperature", f"window_{name}", f"window_{name}")
        for name in ("count", "min", "max", "avg", "start")
    ]
    wide = views.groupBy("zone_id").agg(*per_type, *digest)
    return zones.withColumnRenamed("id", "zone_id").join(wide, "zone_id", "left")


def active_alerts(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """Open or acknowledged alerts of the given zones."""
    ids = zones.select("zone_id")
    return alerts.filter(F.col("status").isin(*ACTIVE_ALERT_STATUSES)).join(ids, "zone_id", "left_semi")


def with_predictions(zones: DataFrame, predictions: DataFrame) -> DataFrame:
    """Add predicted yields (zone_id, predicted_yield) where there are any."""
    return zones.join(predictions.select("zone_id", "predicted_yield"), "zone_id", "left")


def build_context(
    zones: DataFrame, sensors: DataFrame, readings: DataFrame, alerts: DataFrame, as_of: Instant,
    predict: Callable[[DataFrame], DataFrame] | None = None, model_version: str = "unknown",
    settings: Settings = DEFAULTS,
) -> Context:
    """``predict`` maps the wide zone rows to predicted yields; without it no yield rule runs."""
    wide = zone_wide_view(zones, sensors, readings, as_of, settings)
    if predict is not None:
        wide = with_predictions(wide, predict(wide))
    return Context(wide, active_alerts(alerts, wide), model_version, settings)
