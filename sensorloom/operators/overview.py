"""Hierarchy, target resolution, summaries and fleet overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.numeric import exact_mean
from sensorloom.functions.status import deviation_percent, status_of, worst_status
from sensorloom.functions.time import Instant, check_order, instant
from sensorloom.operators.history import _check_page, below, sensor_stats
from sensorloom.operators.joins import lookup_join
from sensorloom.schemas import ACTIVE_ALERT_STATUSES
from sensorloom.settings import DEFAULTS, Settings

TARGETED_TYPES = ("temperature", "humidity", "soil_moisture")


def zone_targets_long(zones: DataFrame) -> DataFrame:
    """One row per zone and targeted sensor type."""
    rows = ", ".join(
        f"'{kind}', CAST(target_{kind}_min AS DOUBLE), CAST(target_{kind}_max AS DOUBLE)" for kind in TARGETED_TYPES
    )
    unpivoted = f"stack({len(TARGETED_TYPES)}, {rows}) AS (sensor_type, target_min, target_max)"
    return zones.selectExpr("id AS zone_id", "greenhouse_id", unpivoted)


def _target(bound: str) -> str:
    cases = " ".join(f"WHEN '{kind}' THEN CAST(target_{kind}_{bound} AS DOUBLE)" for kind in TARGETED_TYPES)
    return f"CASE sensor_type {cases} END AS target_{bound}"


def placed_sensors(sensors: DataFrame, zones: DataFrame) -> DataFrame:
    """Sensors with their zone's site and the zone's target for their type."""
    places = zones.withColumnRenamed("id", "zone_id").drop("name", "crop_type")
    return sensors.selectExpr("id AS sensor_id", "zone_id", "sensor_type", "unit").join(
        places, "zone_id"
    ).selectExpr("sensor_id", "zone_id", "greenhouse_id", "sensor_type", "unit", _target("min"), _target("max"))


def resolved_ranges(sensors: DataFrame, zones: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The range a sensor alerts on: the zone's when complete, else the CO2 range, else none."""

    def bound(name: str, co2: float) -> str:
        return (
            f"CASE WHEN target_min IS NOT NULL AND target_max IS NOT NULL THEN target_{name} "
            f"WHEN sensor_type = 'co2' THEN {float(co2)}D END AS range_{name}"
        )

    return placed_sensors(sensors, zones).selectExpr(
        "sensor_id", "zone_id", "greenhouse_id", "sensor_type", "unit",
        bound("min", settings.co2_min_ppm), bound("max", settings.co2_max_ppm),
    )


def sensor_summary(
    sensors: DataFrame, zones: DataFrame, readings: DataFrame, start: Instant, end: Instant,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Every sensor with its window statistics and status; sensors without data stay."""
    measured = "current_value", "target_min", "target_max"
    return (
        placed_sensors(sensors, zones)
        .join(sensor_stats(readings, start, end), "sensor_id", "left")
        .selectExpr(
            "sensor_id", "zone_id", "greenhouse_id", "sensor_type", "unit",
            "current_value", "last_updated", "min_value", "max_value", "avg_value",
            "coalesce(reading_count, 0) AS reading_count",
            f"{status_of(*measured, settings.warning_tolerance_percent)} AS status",
            "target_min", "target_max",
            f"{deviation_percent(*measured)} AS deviation_percent",
        )
    )


def zone_overview(zones: DataFrame, summaries: DataFrame) -> DataFrame:
    """Every zone with the worst status of its sensors."""
    worst = summaries.groupBy("zone_id").agg(
        F.expr(worst_status("status")).alias("worst"), F.count(F.lit(1)).alias("sensor_count")
    )
    return zones.withColumnRenamed("id", "zone_id").join(worst, "zone_id", "left").select(
        "zone_id", "greenhouse_id", "name", "crop_type",
        F.coalesce("worst", F.lit("unknown")).alias("overall_status"),
        F.coalesce("sensor_count", F.lit(0)).alias("sensor_count"),
    )


def zone_documents(zones: DataFrame, summaries: DataFrame) -> DataFrame:
    """Zone overviews with the sensor summaries nested; a zone has one sensor per type."""
    fields = [c for c in summaries.columns if c not in {"zone_id", "greenhouse_id"}]
    nested = summaries.groupBy("zone_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("readings")
    )
    return zone_overview(zones, summaries).join(nested, "zone_id", "left").withColumn(
        "readings", F.coalesce("readings", F.array().cast(nested.schema["readings"].dataType))
    )


def open_counts(greenhouses: DataFrame, alerts: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Open items per site, of every site at once."""
    active = alerts.filter(F.col("status").isin(*ACTIVE_ALERT_STATUSES)).groupBy("greenhouse_id").agg(
        F.count(F.lit(1)).alias("open_alerts_count"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts_count"),
    )
    opened = recommendations.filter("status = 'open'").groupBy("greenhouse_id").agg(
        F.count(F.lit(1)).alias("open_recommendations_count"),
        F.count_if(F.col("priority").isin("high", "critical")).alias("high_priority_recommendations_count"),
    )
    counts = [*active.columns[1:], *opened.columns[1:]]
    sites = greenhouses.select(F.col("id").alias("greenhouse_id"))
    joined = sites.join(active, "greenhouse_id", "left").join(opened, "greenhouse_id", "left")
    return joined.select("greenhouse_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def greenhouse_overview(
    greenhouses: DataFrame, zone_overviews: DataFrame, counts: DataFrame, start: Instant, end: Instant
) -> DataFrame:
    """Every site with its worst zone status, window and open items; empty sites stay."""
    check_order(start, end)
    by_site = zone_overviews.groupBy("greenhouse_id").agg(
        F.expr(worst_status("overall_status")).alias("worst"),
        F.count(F.lit(1)).alias("zone_count"),
        F.sum("sensor_count").alias("sensors"),
    )
    sites = greenhouses.select(F.col("id").alias("greenhouse_id"), "name", "location")
    return sites.join(by_site, "greenhouse_id", "left").join(counts, "greenhouse_id").select(
        "greenhouse_id", "name", "location",
        F.coalesce("worst", F.lit("unknown")).alias("overall_status"),
        instant(start).alias("window_start"), instant(end).alias("window_end"),
        F.coalesce("zone_count", F.lit(0)).alias("zone_count"),
        F.coalesce("sensors", F.lit(0)).alias("sensor_count"),
        "open_alerts_count", "critical_alerts_count",
        "open_recommendations_count", "high_priority_recommendations_count",
    )


def topology(greenhouses: DataFrame, zones: DataFrame, sensors: DataFrame) -> DataFrame:
    """The hierarchy as one row per site and zone, the zone's sensors nested by id.

    A zone holds one sensor per type, so the nested list is short; a site's zones are
    rows because a site may have any number of them. Empty sites and zones stay.
    """
    nested = sensors.groupBy("zone_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "sensor_type", "unit", "status"))).alias("sensors")
    )
    empty = F.array().cast(nested.schema["sensors"].dataType)
    placed = zones.withColumnsRenamed({"id": "zone_id", "name": "zone_name"}).join(nested, "zone_id", "left")
    sites = greenhouses.select(
        F.col("id").alias("greenhouse_id"), F.col("name").alias("greenhouse_name"), "location", "status"
    )
    return _zones_under(sites, placed).withColumn("sensors", F.coalesce("sensors", empty))


def _zones_under(sites: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per site and zone, empty sites with null zone columns.

    Zones look up their site, not the other way round: a site may hold most of the zones.
    """
    filled = lookup_join(zones, sites, "greenhouse_id")
    vacant = sites.join(zones.select("greenhouse_id").distinct(), "greenhouse_id", "left_anti")
    below = [c for c in zones.columns if c != "greenhouse_id"]
    return filled.unionByName(vacant, allowMissingColumns=True).select(*sites.columns, *below)


def fleet_kpis(summaries: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of fleet totals, from summaries and open counts in a single aggregate."""
    value, kind = F.col("current_value"), F.col("sensor_type")
    measured = summaries.select(
        value.isNotNull().cast("long").alias("active_sensors"),
        (F.col("status") == "warning").cast("long").alias("warning_count"),
        (F.col("status") == "critical").cast("long").alias("critical_count"),
        *[F.when(kind == k, value).alias(f"{k}_value") for k in TARGETED_TYPES],
    )
    totals = {
        "open_alerts": "open_alerts_count",
        "critical_alerts": "critical_alerts_count",
        "open_recommendations": "open_recommendations_count",
        "high_priority_recommendations": "high_priority_recommendations_count",
    }
    opened = counts.select(*[F.col(source).alias(name) for name, source in totals.items()])
    both = measured.unionByName(opened, allowMissingColumns=True)

    def total(name):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    return both.agg(
        total("active_sensors"), total("warning_count"), total("critical_count"),
        F.expr(exact_mean("temperature_value")).alias("avg_temperature"),
        F.expr(exact_mean("humidity_value")).alias("avg_humidity"),
        F.expr(exact_mean("soil_moisture_value")).alias("avg_soil_moisture"),
        *[total(name) for name in totals],
    )


def filtered(frame: DataFrame, **equal) -> DataFrame:
    """Rows matching every given value; arguments left at None do not filter."""
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    return frame.filter(reduce(lambda a, b: a & b, tests)) if tests else frame


def listing(
    frame: DataFrame, limit: int = 50, offset: int = 0, after: tuple[Instant, int] | None = None,
    most: int | None = None, **equal,
) -> DataFrame:
    """A page of alerts or recommendations, newest first; pages as in ``sensor_history``."""
    _check_page(limit, offset, most)
    ordered = below(filtered(frame, **equal), "created_at", after).orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered.offset(offset).limit(limit)


def listing_total(frame: DataFrame, **equal) -> DataFrame:
    return filtered(frame, **equal).agg(F.count(F.lit(1)).alias("total"))


def alert_banner(alerts: DataFrame, newest: int = 10, shown: int = 3) -> DataFrame:
    """Per site and severity, among its newest open alerts: how many, and the first few."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    by_site = Window.partitionBy("greenhouse_id").orderBy(*order)
    top = (
        alerts.filter("status = 'open'")
        .withColumn("_rank", F.row_number().over(by_site))
        .filter(F.col("_rank") <= newest)
        .filter(F.col("severity").isin("critical", "warning"))
    )
    group = Window.partitionBy("greenhouse_id", "severity")
    return (
        top.withColumns({
            "severity_count": F.count(F.lit(1)).over(group),
            "position": F.row_number().over(group.orderBy(*order)),
        })
        .filter(F.col("position") <= shown)
        .select("greenhouse_id", "severity", "severity_count", "position", F.col("id").alias("alert_id"), "message")
    )
