"""Lookups, latest values and pages of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.numeric import exact_mean
from sensorloom.functions.time import Instant, between, check_order, hours_before, instant
from sensorloom.operators.joins import lookup_join


def _check_page(limit: int, offset: int, most: int | None) -> None:
    if limit < 1 or offset < 0 or (most is not None and limit > most):
        raise ValueError("limit must be positive, within the most allowed, and offset not negative")


def below(frame: DataFrame, time: str, after: tuple[Instant, int] | None) -> DataFrame:
    """Rows that follow the last row of a page, newest first, given that row's time and id.

    Pages found this way keep one page of rows a task, however deep they lie.
    """
    if after is None:
        return frame
    at, last = instant(after[0]), F.lit(after[1])
    return frame.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col("id") < last)))


def greenhouse_listing(greenhouses: DataFrame, greenhouse_id: int | None = None) -> DataFrame:
    found = greenhouses if greenhouse_id is None else greenhouses.filter(F.col("id") == greenhouse_id)
    return found.orderBy("id")


def zones_of_greenhouse(zones: DataFrame, greenhouse_id: int | None = None) -> DataFrame:
    """Zones by id, of one site or of every site in turn."""
    found = zones if greenhouse_id is None else zones.filter(F.col("greenhouse_id") == greenhouse_id)
    return found.orderBy("greenhouse_id", "id")


def sensors_of_zone(sensors: DataFrame, zone_id: int | None = None) -> DataFrame:
    """Sensors by id, of one zone or of every zone in turn."""
    found = sensors if zone_id is None else sensors.filter(F.col("zone_id") == zone_id)
    return found.orderBy("zone_id", "id")


def _page(
    readings: DataFrame, start: Instant | None, end: Instant | None, limit: int, offset: int,
    after: tuple[Instant, int] | None, most: int | None,
) -> DataFrame:
    _check_page(limit, offset, most)
    return (
        below(readings, "timestamp", after)
        .filter(between(F.col("timestamp"), start, end))
        .select("id", "sensor_id", "timestamp", F.col("value").cast("double").alias("value"))
        .orderBy(F.col("timestamp").desc(), F.col("id").desc())
        .offset(offset)
        .limit(limit)
    )


def sensor_history(
    readings: DataFrame, sensors: DataFrame, sensor_id: int,
    start: Instant | None = None, end: Instant | None = None, limit: int = 1000, offset: int = 0,
    after: tuple[Instant, int] | None = None, most: int | None = None,
) -> DataFrame:
    """One sensor's readings, newest first; empty for a sensor that does not exist.

    ``after`` is the (timestamp, id) of the last row of the page before; ``most`` bounds the
    limit where a client contract does.
    """
    known = sensors.filter(F.col("id") == sensor_id).select(F.col("id").alias("sensor_id"))
    own = lookup_join(readings.filter(F.col("sensor_id") == sensor_id), known, "sensor_id", "left_semi")
    return _page(own, start, end, limit, offset, after, most)


def greenhouse_history(
    readings: DataFrame, sensors: DataFrame, zones: DataFrame, greenhouse_id: int,
    sensor_type: str | None = None,
    start: Instant | None = None, end: Instant | None = None, limit: int = 1000, offset: int = 0,
    after: tuple[Instant, int] | None = None, most: int | None = None,
) -> DataFrame:
    """A site's readings of all or one sensor type, newest first; pages as in ``sensor_history``."""
    placed = zones.filter(F.col("greenhouse_id") == greenhouse_id).select(F.col("id").alias("zone_id"))
    own = sensors if sensor_type is None else sensors.filter(F.col("sensor_type") == sensor_type)
    ids = own.join(placed, "zone_id", "left_semi").select(F.col("id").alias("sensor_id"))
    return _page(lookup_join(readings, ids, "sensor_id", "left_semi"), start, end, limit, offset, after, most)


def latest_per_sensor(readings: DataFrame) -> DataFrame:
    """Newest reading per sensor by partial aggregation: no sort, one row per task and sensor.

    Relies on (sensor_id, timestamp) being unique, as stored readings are.
    """
    return readings.groupBy("sensor_id").agg(
        F.max_by(F.col("value").cast("double"), "timestamp").alias("value"), F.max("timestamp").alias("timestamp")
    )


def latest_readings(
    readings: DataFrame, sensors: DataFrame, zones: DataFrame, greenhouse_id: int | None = None
) -> DataFrame:
    sites = zones if greenhouse_id is None else zones.filter(F.col("greenhouse_id") == greenhouse_id)
    places = sensors.select(F.col("id").alias("sensor_id"), "zone_id", "sensor_type", "unit").join(
        sites.select(F.col("id").alias("zone_id"), "greenhouse_id"), "zone_id"
    )
    return latest_per_sensor(readings).join(places, "sensor_id").select(
        "greenhouse_id", "sensor_id", "zone_id", "sensor_type", "unit", "value", "timestamp"
    )


def sensor_stats(readings: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Per sensor in the closed window: current value and min, max, average, count."""
    check_order(start, end)
    value = F.col("value").cast("double")
    return readings.filter(between(F.col("timestamp"), start, end)).groupBy("sensor_id").agg(
        F.max_by(value, "timestamp").alias("current_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.expr(exact_mean("value")).alias("avg_value"),
        F.count(F.lit(1)).alias("reading_count"),
        F.max("timestamp").alias("last_updated"),
    )


def readings_total(readings: DataFrame) -> DataFrame:
    return readings.agg(F.count(F.lit(1)).alias("readings_total"))


def recent_readings(readings: DataFrame, as_of: Instant, max_age_hours: int, rows: int) -> DataFrame:
    """The newest ``rows`` readings per sensor since the cutoff, with their rank.

    The rank filter is planned as a group limit, so a task sends at most ``rows``
    readings of a sensor into the exchange.
    """
    newest = Window.partitionBy("sensor_id").orderBy(F.col("timestamp").desc())
    return (
        readings.filter(F.col("timestamp") >= hours_before(as_of, max_age_hours))
        .select("sensor_id", "timestamp", F.col("value").cast("double").alias("value"))
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= rows)
    )


def multi_window_stats(readings: DataFrame, as_of: Instant, hours: tuple[int, ...] = (1, 6, 24, 168)) -> DataFrame:
    """Min, max, average and latest per sensor over several trailing windows, in one pass."""
    recent = readings.select(
        "sensor_id", "timestamp", F.col("value").cast("double").alias("value"), instant(as_of).alias("as_of")
    ).filter(F.col("timestamp") >= hours_before(as_of, max(hours)))
    aggregates, windows = [], []
    for h in hours:
        inside = f"timestamp >= as_of - INTERVAL {h} HOURS"
        value = f"if({inside}, value, NULL)"
        columns = {
            "min_value": f"min({value})",
            "max_value": f"max({value})",
            "avg_value": exact_mean(value),
            "latest_value": f"max_by({value}, if({inside}, timestamp, NULL))",
            "reading_count": f"count({value})",
        }
        aggregates += [F.expr(f"{text} AS {name}_{h}") for name, text in columns.items()]
        fields = ", ".join(f"'{name}', {name}_{h}" for name in columns)
        windows.append(f"named_struct('window_hours', {h}, {fields})")
    wide = recent.groupBy("sensor_id").agg(*aggregates)
    return wide.selectExpr("sensor_id", f"inline(array({', '.join(windows)}))")
