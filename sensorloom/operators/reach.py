"""Which days a change of readings reaches, from the number of readings a sensor has each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.settings import DEFAULTS

KEYS = ("sensor_id", "reading_date")


def sensor_days(clean: DataFrame) -> DataFrame:
    """Per sensor and day: readings, outliers and the last time."""
    return clean.groupBy("sensor_id", F.to_date("timestamp").alias("reading_date")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_outlier").alias("outliers"),
        F.max("timestamp").alias("last_seen_at"),
    )


def _laid_out(days: DataFrame) -> DataFrame:
    """Days with the number of the sensor's readings before them (``_start``) and up to their end (``_end``)."""
    up_to = Window.partitionBy("sensor_id").orderBy("reading_date")
    return days.withColumn("_end", F.sum("rows").over(up_to)).withColumn("_start", F.col("_end") - F.col("rows"))


def changed_days(days: DataFrame, changed: DataFrame, rows: int = DEFAULTS.rolling_rows) -> DataFrame:
    """The (sensor, day) pairs whose cleaned readings may differ after ``changed`` readings came.

    A reading changes its own day and the flags of the ``rows`` readings after it. ``days`` is
    the state before the change: readings are only added or replaced, so its counts are never
    too high and the reach is never too short.
    """
    touched = changed.select("sensor_id", F.to_date("timestamp").alias("reading_date")).filter(
        "sensor_id IS NOT NULL AND reading_date IS NOT NULL"
    )
    marked = (
        days.select(*KEYS, "rows", F.lit(False).alias("touched"))
        .unionByName(touched.select(*KEYS, F.lit(0).cast("long").alias("rows"), F.lit(True).alias("touched")))
        .groupBy(*KEYS)
        .agg(F.sum("rows").alias("rows"), F.bool_or("touched").alias("touched"))
    )
    earlier = Window.partitionBy("sensor_id").orderBy("reading_date").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("touched"), F.col("_end"))).over(earlier)
    near = F.coalesce(F.col("_start") - F.col("_last") < rows, F.lit(False))
    return _laid_out(marked).withColumn("_last", last).filter(F.col("touched") | near).select(*KEYS)


def days_to_read(days: DataFrame, dates: list, rows: int = DEFAULTS.rolling_rows) -> DataFrame:
    """The (sensor, day) pairs before ``dates`` that hold the frames of readings on these dates.

    A sensor may be new on a date, so the start of each date counts for every sensor.
    """
    wanted = F.col("reading_date").isin(dates)
    starts = days.select("sensor_id").distinct().select("sensor_id", F.explode(F.array(*map(F.lit, dates))).alias("reading_date"))
    every = (
        days.select(*KEYS, "rows")
        .unionByName(starts.withColumn("rows", F.lit(0).cast("long")))
        .groupBy(*KEYS)
        .agg(F.sum("rows").alias("rows"))
    )
    later = Window.partitionBy("sensor_id").orderBy("reading_date").rowsBetween(1, Window.unboundedFollowing)
    following = F.min(F.when(wanted, F.col("_start"))).over(later)
    return (
        _laid_out(every)
        .withColumn("_next", following)
        .filter(~wanted & (F.col("_next") - F.col("_end") < rows))
        .select(*KEYS)
    )
