"""Declared schemas and value domains; nothing in the package infers a schema."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


GREENHOUSES = _struct(
    ("id", IntegerType(), False),
    ("name", StringType(), False),
    ("location", StringType(), False),
    ("status", StringType(), False),
    ("created_at", TimestampType(), False),
    ("updated_at", TimestampType(), False),
)

ZONES = _struct(
    ("id", IntegerType(), False),
    ("greenhouse_id", IntegerType(), False),
    ("name", StringType(), False),
    ("crop_type", StringType(), False),
    ("target_temperature_min", DecimalType(6, 2), True),
    ("target_temperature_max", DecimalType(6, 2), True),
    ("target_humidity_min", DecimalType(5, 2), True),
    ("target_humidity_max", DecimalType(5, 2), True),
    ("target_soil_moisture_min", DecimalType(5, 2), True),
    ("target_soil_moisture_max", DecimalType(5, 2), True),
)

SENSORS = _struct(
    ("id", IntegerType(), False),
    ("zone_id", IntegerType(), False),
    ("sensor_type", StringType(), False),
    ("unit", StringType(), False),
    ("status", StringType(), False),
    ("created_at", TimestampType(), False),
)

READINGS = _struct(
    ("id", LongType(), True),
    ("sensor_id", IntegerType(), True),
    ("timestamp", TimestampType(), True),
    ("value", DecimalType(12, 4), True),
)

CLEAN_READINGS = _struct(
    ("id", LongType(), True),
    ("sensor_id", IntegerType(), True),
    ("sensor_type", StringType(), True),
    ("timestamp", TimestampType(), True),
    ("value", DoubleType(), True),
    ("is_outlier", BooleanType(), True),
)

ALERTS = _struct(
    ("id", LongType(), False),
    ("greenhouse_id", IntegerType(), False),
    ("zone_id", IntegerType(), True),
    ("sensor_id", IntegerType(), True),
    ("alert_type", StringType(), False),
    ("severity", StringType(), False),
    ("status", StringType(), False),
    ("message", StringType(), False),
    ("value", DecimalType(12, 4), True),
    ("threshold", StringType(), True),
    ("created_at", TimestampType(), False),
    ("acknowledged_at", TimestampType(), True),
    ("resolved_at", TimestampType(), True),
)

RECOMMENDATIONS = _struct(
    ("id", LongType(), False),
    ("greenhouse_id", IntegerType(), False),
    ("zone_id", IntegerType(), True),
    ("sensor_id", IntegerType(), True),
    ("recommendation_type", StringType(), False),
    ("priority", StringType(), False),
    ("status", StringType(), False),
    ("message", StringType(), False),
    ("reason", StringType(), False),
    ("created_at", TimestampType(), False),
    ("updated_at", TimestampType(), False),
    ("resolved_at", TimestampType(), True),
)

CANDIDATE_RECOMMENDATIONS = _struct(
    ("recommendation_type", StringType(), False),
    ("priority", StringType(), False),
    ("greenhouse_id", IntegerType(), True),
    ("zone_id", IntegerType(), True),
    ("sensor_id", IntegerType(), True),
    ("message", StringType(), True),
    ("reason", StringType(), True),
    ("source_id", LongType(), True),
)

YIELD_RECORDS = _struct(
    ("crop_type", StringType(), True),
    ("avg_temperature_C", DoubleType(), True),
    ("min_temperature_C", DoubleType(), True),
    ("max_temperature_C", DoubleType(), True),
    ("humidity_percent", DoubleType(), True),
    ("co2_ppm", DoubleType(), True),
    ("light_intensity_lux", DoubleType(), True),
    ("photoperiod_hours", DoubleType(), True),
    ("irrigation_mm", DoubleType(), True),
    ("fertilizer_N_kg_ha", DoubleType(), True),
    ("fertilizer_P_kg_ha", DoubleType(), True),
    ("fertilizer_K_kg_ha", DoubleType(), True),
    ("pest_severity", DoubleType(), True),
    ("soil_pH", DoubleType(), True),
    ("days_to_maturity", IntegerType(), True),
    ("yield_kg_per_m2", DoubleType(), True),
)

# The domains every string column with a closed set may take.
SENSOR_TYPES = ("temperature", "humidity", "soil_moisture", "light", "co2", "irrigation")
CROP_TYPES = ("tomato", "lettuce", "pepper", "cucumber")
GREENHOUSE_STATUSES = ("active", "inactive", "maintenance")
SENSOR_STATUSES = ("active", "inactive", "maintenance", "error")
ALERT_TYPES = ("threshold_high", "threshold_low", "anomaly")
ALERT_SEVERITIES = ("info", "warning", "critical")
ALERT_STATUSES = ("open", "acknowledged", "resolved")
ACTIVE_ALERT_STATUSES = ("open", "acknowledged")
RECOMMENDATION_TYPES = (
    "irrigation_needed",
    "temperature_high",
    "temperature_low",
    "humidity_high_risk",
    "co2_out_of_range",
    "anomaly_review",
    "yield_risk",
)
RECOMMENDATION_PRIORITIES = ("low", "medium", "high", "critical")
RECOMMENDATION_STATUSES = ("open", "dismissed", "completed")
ENVIRONMENT_STATUSES = ("unknown", "normal", "warning", "critical")  # least to most severe
