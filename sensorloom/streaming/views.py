"""Views over a stream of readings: latest values, closed hours and an hourly table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators.ingestion import on_dates_of
from sensorloom.operators.joins import lookup_join
from sensorloom.operators.rollups import hourly_rollup, rollup_metrics
from sensorloom.sources.files import write_table

HOUR_PARTITIONS = ("hour_date", "hour_of_day")


def table_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest_values(readings: DataFrame) -> DataFrame:
    """Current value per sensor, for update or complete mode.

    The newest event time wins, whatever the arrival order; the state is one row per sensor.
    """
    return readings.groupBy("sensor_id").agg(
        F.max_by("value", "timestamp").alias("value"), F.max("timestamp").alias("timestamp")
    )


def hourly_stream(clean: DataFrame, sensors: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The hourly roll-up, each hour emitted once the watermark has passed its end.

    An emitted hour is final, so readings that are later than the watermark are not in it;
    ``start_hours`` keeps a table that has them.
    """
    zones = sensors.select(F.col("id").alias("sensor_id"), "zone_id")
    usual = clean.filter(~F.col("is_outlier")).withWatermark("timestamp", lateness)
    hours = lookup_join(usual, zones, "sensor_id").groupBy(
        "zone_id", "sensor_type", F.window("timestamp", "1 hour").alias("hour")
    )
    return hours.agg(*rollup_metrics("value")).select(
        "zone_id", "sensor_type", F.col("hour.start").alias("hour_utc"),
        "min_value", "max_value", "avg_value", "std_value", "sample_count",
    )


def refresh_hours(
    arrived: DataFrame, stored: Callable[[], DataFrame], sensors: Callable[[], DataFrame], path: str
) -> None:
    """Roll the hours of one micro-batch up again from all their stored clean readings.

    However late a reading is, its hour is replaced as a whole, so the table equals the
    batch roll-up and a batch that runs again leaves the same rows.
    """
    hour = F.date_trunc("hour", "timestamp")
    oldest, newest = arrived.select(F.unix_seconds(hour).alias("at")).agg(F.min("at"), F.max("at")).first()
    if oldest is None:
        return
    touched = arrived.select(hour.alias("_hour")).distinct()
    since, until = (F.timestamp_seconds(F.lit(second)) for second in (oldest, newest + 3600))
    table = stored()
    if "reading_date" in table.columns:  # a partition column: only the touched dates are read
        table = on_dates_of(table, arrived)
    near = table.filter((F.col("timestamp") >= since) & (F.col("timestamp") < until)).withColumn("_hour", hour)
    hours = hourly_rollup(lookup_join(near, touched, "_hour", "left_semi"), sensors())
    dated = hours.withColumns({"hour_date": F.to_date("hour_utc"), "hour_of_day": F.hour("hour_utc")})
    write_table(dated, path, HOUR_PARTITIONS, ("zone_id", "sensor_type"), replace="partitions")


def stored_hours(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*HOUR_PARTITIONS)


def start_hours(
    clean: DataFrame,
    stored: Callable[[], DataFrame],
    sensors: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Follow the stored clean readings and keep their hourly table, late readings included."""
    return (
        clean.writeStream.queryName("hours")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda frame, batch_id: refresh_hours(frame, stored, sensors, path))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
