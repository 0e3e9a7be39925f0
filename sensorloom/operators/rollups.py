"""Hourly, daily and per-sensor roll-ups of cleaned readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.numeric import exact_mean, percent_of
from sensorloom.functions.time import Instant, minutes_before
from sensorloom.operators.joins import lookup_join
from sensorloom.settings import DEFAULTS


def rollup_metrics(value: str) -> list:
    return [
        F.min(value).cast("double").alias("min_value"),
        F.max(value).cast("double").alias("max_value"),
        F.expr(exact_mean(value)).alias("avg_value"),
        F.stddev_pop(F.col(value).cast("double")).alias("std_value"),
        F.count(F.lit(1)).alias("sample_count"),
    ]


def hourly_rollup(clean: DataFrame, sensors: DataFrame) -> DataFrame:
    """Per zone, sensor type and hour, over readings that are no outliers."""
    located = lookup_join(
        clean.filter(~F.col("is_outlier")), sensors.select(F.col("id").alias("sensor_id"), "zone_id"), "sensor_id"
    )
    return located.groupBy(
        "zone_id", "sensor_type", F.date_trunc("hour", "timestamp").alias("hour_utc")
    ).agg(*rollup_metrics("value"))


def hourly_zone_metrics(hourly: DataFrame, dim_zone: DataFrame) -> DataFrame:
    """The hourly roll-up with its site."""
    sites = dim_zone.select("zone_id", "greenhouse_id")
    return lookup_join(hourly, sites, "zone_id").select(
        "zone_id", "greenhouse_id", "sensor_type", "hour_utc",
        "min_value", "max_value", "avg_value", "std_value", "sample_count",
    )


def daily_greenhouse_metrics(fact: DataFrame, dim_zone: DataFrame) -> DataFrame:
    """Per site, day and sensor type; outliers are left out before they are counted."""
    sites = dim_zone.select("zone_id", "greenhouse_id")
    usual = fact.filter(~F.col("is_outlier")).drop("greenhouse_id")
    return (
        lookup_join(usual, sites, "zone_id")
        .groupBy("greenhouse_id", F.to_date("reading_timestamp").alias("metric_date"), "sensor_type")
        .agg(*rollup_metrics("reading_value"), F.count_if("is_outlier").alias("outlier_count"))
    )


def sensor_health_summary(
    fact: DataFrame, as_of: Instant, reporting_minutes: int = DEFAULTS.reporting_minutes
) -> DataFrame:
    totals = fact.groupBy("sensor_id", "zone_id", "greenhouse_id", "sensor_type").agg(
        F.count(F.lit(1)).alias("total_readings"),
        F.count_if("is_outlier").alias("outlier_readings"),
        F.max("reading_timestamp").alias("last_seen_at"),
    )
    return _health(totals, as_of, reporting_minutes)


def health_of_days(
    days: DataFrame, places: DataFrame, as_of: Instant, reporting_minutes: int = DEFAULTS.reporting_minutes
) -> DataFrame:
    """The same summary from one row per sensor and day and the place of each sensor."""
    totals = days.groupBy("sensor_id").agg(
        F.sum("rows").alias("total_readings"),
        F.sum("outliers").alias("outlier_readings"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    return _health(lookup_join(totals, places, "sensor_id"), as_of, reporting_minutes)


def _health(totals: DataFrame, as_of: Instant, reporting_minutes: int) -> DataFrame:
    return totals.select(
        "sensor_id", "zone_id", "greenhouse_id", "sensor_type", "total_readings", "outlier_readings",
        F.expr(percent_of("outlier_readings", "total_readings")).alias("outlier_pct"),
        "last_seen_at",
        (F.col("last_seen_at") > minutes_before(as_of, reporting_minutes)).alias("is_reporting"),
    )
