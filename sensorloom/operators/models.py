"""Typed staging projections, dimensions and the reading fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.joins import lookup_join


def _project(frame: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    return frame.select(*[F.col(source).cast(kind).alias(name) for name, (source, kind) in columns.items()])


def stg_sensor_readings(clean: DataFrame) -> DataFrame:
    return _project(clean, {
        "reading_id": ("id", "long"),
        "sensor_id": ("sensor_id", "int"),
        "sensor_type": ("sensor_type", "string"),
        "reading_timestamp": ("timestamp", "timestamp"),
        "reading_value": ("value", "decimal(12,4)"),
        "is_outlier": ("is_outlier", "boolean"),
    })


def stg_sensors(sensors: DataFrame) -> DataFrame:
    return _project(sensors, {
        "sensor_id": ("id", "int"),
        "zone_id": ("zone_id", "int"),
        "sensor_type": ("sensor_type", "string"),
        "unit": ("unit", "string"),
        "status": ("status", "string"),
        "created_at": ("created_at", "timestamp"),
    })


def stg_zones(zones: DataFrame) -> DataFrame:
    return _project(zones, {
        "zone_id": ("id", "int"),
        "greenhouse_id": ("greenhouse_id", "int"),
        "zone_name": ("name", "string"),
        "crop_type": ("crop_type", "string"),
        "target_temperature_min": ("target_temperature_min", "decimal(6,2)"),
        "target_temperature_max": ("target_temperature_max", "decimal(6,2)"),
        "target_humidity_min": ("target_humidity_min", "decimal(5,2)"),
        "target_humidity_max": ("target_humidity_max", "decimal(5,2)"),
        "target_soil_moisture_min": ("target_soil_moisture_min", "decimal(5,2)"),
        "target_soil_moisture_max": ("target_soil_moisture_max", "decimal(5,2)"),
    })


def stg_greenhouses(greenhouses: DataFrame) -> DataFrame:
    return _project(greenhouses, {
        "greenhouse_id": ("id", "int"),
        "greenhouse_name": ("name", "string"),
        "location": ("location", "string"),
        "status": ("status", "string"),
        "created_at": ("created_at", "timestamp"),
        "updated_at": ("updated_at", "timestamp"),
    })


def stg_alerts(alerts: DataFrame) -> DataFrame:
    return _project(alerts, {
        "alert_id": ("id", "long"),
        "greenhouse_id": ("greenhouse_id", "int"),
        "zone_id": ("zone_id", "int"),
        "sensor_id": ("sensor_id", "int"),
        "alert_type": ("alert_type", "string"),
        "severity": ("severity", "string"),
        "status": ("status", "string"),
        "message": ("message", "string"),
        "value": ("value", "decimal(12,4)"),
        "threshold": ("threshold", "string"),
        "created_at": ("created_at", "timestamp"),
        "acknowledged_at": ("acknowledged_at", "timestamp"),
        "resolved_at": ("resolved_at", "timestamp"),
    })


def dim_greenhouse(staged: DataFrame) -> DataFrame:
    return staged.select("greenhouse_id", "greenhouse_name", "location", "status", "created_at", "updated_at")


def dim_zone(staged: DataFrame) -> DataFrame:
    return staged.select(
        "zone_id", "greenhouse_id", "zone_name", "crop_type",
        "target_temperature_min", "target_temperature_max",
        "target_humidity_min", "target_humidity_max",
        "target_soil_moisture_min", "target_soil_moisture_max",
    )


def dim_sensor(staged: DataFrame) -> DataFrame:
    return staged.select("sensor_id", "zone_id", "sensor_type", "unit", "status", "created_at")


def dim_date(staged_readings: DataFrame) -> DataFrame:
    """Every day from the first to the last reading; Sunday is day 0, weeks are ISO."""
    bounds = staged_readings.agg(
        F.to_date(F.min("reading_timestamp")).alias("first"), F.to_date(F.max("reading_timestamp")).alias("last")
    ).filter("first IS NOT NULL")
    day = F.col("date_day")
    return bounds.select(F.explode(F.sequence("first", "last")).alias("date_day")).select(
        day,
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        (F.dayofweek(day) - 1).alias("day_of_week"),
        F.weekofyear(day).alias("week_of_year"),
    )


def sensor_places(staged_sensors: DataFrame, staged_zones: DataFrame) -> DataFrame:
    """The zone and the site of each sensor."""
    return staged_sensors.select("sensor_id", "zone_id", "sensor_type").join(
        staged_zones.select("zone_id", "greenhouse_id"), "zone_id"
    )


def fact_sensor_readings(staged_readings: DataFrame, staged_sensors: DataFrame, staged_zones: DataFrame) -> DataFrame:
    """Readings with their place; the two dimensions meet before the fact does."""
    places = sensor_places(staged_sensors, staged_zones).drop("sensor_type")
    return lookup_join(staged_readings, places, "sensor_id").select(
        "reading_id",
        "reading_timestamp",
        F.date_trunc("hour", "reading_timestamp").alias("hour_utc"),
        "sensor_id",
        "zone_id",
        "greenhouse_id",
        "sensor_type",
        "reading_value",
        "is_outlier",
    )
