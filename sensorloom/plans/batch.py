"""The scheduled refresh: clean, roll up, model and check, in that order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.functions.time import Instant
from sensorloom.operators import cleaning, models, quality, reach, rollups
from sensorloom.sources.files import read_table, write_table


@dataclass(frozen=True)
class Sources:
    greenhouses: DataFrame
    zones: DataFrame
    sensors: DataFrame
    readings: DataFrame


def _on(frame: DataFrame, dates: list | None, column: str = "reading_date") -> DataFrame:
    return frame if dates is None else frame.filter(F.col(column).isin(dates))


def _clean_table(spark: SparkSession, out: str, dates: list | None = None) -> DataFrame:
    return _on(read_table(spark, f"{out}/staging/sensor_readings_clean"), dates).drop("reading_date")


def _days_table(spark: SparkSession, out: str) -> DataFrame:
    return read_table(spark, f"{out}/staging/sensor_days")


def changed_dates(days: DataFrame, changed: DataFrame) -> list:
    """The dates to refresh after ``changed`` readings came, at most one for each day of the calendar."""
    return sorted(row[0] for row in reach.changed_days(days, changed).select("reading_date").distinct().collect())


def _readings_for(readings: DataFrame, days: DataFrame, dates: list) -> DataFrame:
    """Readings of the dates and, of each sensor, of the days before that fill the frames.

    With a ``reading_date`` partition column other dates are not read.
    """
    before = reach.days_to_read(days, dates)
    needed = sorted({row[0] for row in before.select("reading_date").distinct().collect()} | set(dates))
    dated = readings if "reading_date" in readings.columns else readings.withColumn("reading_date", F.to_date("timestamp"))
    near = _on(dated, needed)
    earlier = near.filter(~F.col("reading_date").isin(dates))
    return _on(near, dates).unionByName(earlier.join(before, list(reach.KEYS), "left_semi")).drop("reading_date")


def refresh_staging(sources: Sources, out: str, dates: list | None = None) -> dict[str, int]:
    """Write cleaned readings, then the days and the hourly roll-up from what was written.

    With ``dates`` only their partitions are replaced.
    """
    spark, replace = sources.readings.sparkSession, "table" if dates is None else "partitions"
    readings = sources.readings
    if dates is not None:
        readings = _readings_for(readings, _days_table(spark, out), dates)
    clean = cleaning.clean_readings(readings, sources.sensors).withColumn("reading_date", F.to_date("timestamp"))
    rows = write_table(
        _on(clean, dates), f"{out}/staging/sensor_readings_clean", ("reading_date",), ("sensor_id", "timestamp"), replace
    )
    staged = _clean_table(spark, out, dates)
    hourly = rollups.hourly_rollup(staged, sources.sensors).withColumn("hour_date", F.to_date("hour_utc"))
    return {
        "sensor_readings_clean": rows,
        "hourly_zone_metrics": write_table(
            hourly, f"{out}/staging/hourly_zone_metrics", ("hour_date",), ("zone_id", "hour_utc"), replace
        ),
        "sensor_days": write_table(
            reach.sensor_days(staged), f"{out}/staging/sensor_days", ("reading_date",), ("sensor_id",), replace
        ),
    }


def refresh_marts(sources: Sources, out: str, as_of: Instant, dates: list | None = None) -> dict[str, int]:
    """Write dimensions and facts from staging; the marts read the written fact.

    With ``dates`` the fact and the hourly and daily marts replace only these dates. Totals of
    a sensor and the range of days come from its days, so no refresh reads the whole fact.
    """
    spark, replace = sources.readings.sparkSession, "table" if dates is None else "partitions"
    sensors, zones = models.stg_sensors(sources.sensors), models.stg_zones(sources.zones)
    dim_zone = models.dim_zone(zones)
    staged = models.stg_sensor_readings(_clean_table(spark, out, dates))
    fact = models.fact_sensor_readings(staged, sensors, zones).withColumn(
        "reading_date", F.to_date("reading_timestamp")
    )
    counts = {
        "fact_sensor_readings": write_table(
            fact, f"{out}/marts/fact_sensor_readings", ("reading_date",), ("sensor_id", "reading_timestamp"), replace
        )
    }
    written = _on(read_table(spark, f"{out}/marts/fact_sensor_readings"), dates).drop("reading_date")
    hourly = _on(read_table(spark, f"{out}/staging/hourly_zone_metrics"), dates, "hour_date")
    sites = rollups.hourly_zone_metrics(hourly, dim_zone).withColumn("hour_date", F.to_date("hour_utc"))
    dated = {
        "hourly_zone_metrics": (sites, "hour_date"),
        "daily_greenhouse_metrics": (rollups.daily_greenhouse_metrics(written, dim_zone), "metric_date"),
    }
    for name, (frame, column) in dated.items():
        counts[name] = write_table(frame, f"{out}/marts/{name}", (column,), replace=replace)
    days = _days_table(spark, out)
    marts = {
        "dim_greenhouse": models.dim_greenhouse(models.stg_greenhouses(sources.greenhouses)),
        "dim_zone": dim_zone,
        "dim_sensor": models.dim_sensor(sensors),
        "dim_date": models.dim_date(days.select(F.col("reading_date").cast("timestamp").alias("reading_timestamp"))),
        "sensor_health_summary": rollups.health_of_days(days, models.sensor_places(sensors, zones), as_of),
    }
    return counts | {name: write_table(frame, f"{out}/marts/{name}") for name, frame in marts.items()}


def mart_checks(spark: SparkSession, out: str) -> list[DataFrame]:
    """The declared constraints of the written marts."""

    def mart(name: str) -> DataFrame:
        return read_table(spark, f"{out}/marts/{name}")

    def unique(name: str, column: str) -> DataFrame:
        return quality.unique(mart(name), [column], f"{name}.{column}")

    def refers(name: str, column: str, parent: str) -> DataFrame:
        return quality.relationships(mart(name), column, mart(parent), column, f"{name}.{column}")

    def columns(name: str, *required: str, **domains: tuple[str, ...]) -> DataFrame:
        return quality.column_checks(mart(name), name, required, domains)

    return [
        unique("dim_greenhouse", "greenhouse_id"),
        columns("dim_greenhouse", "greenhouse_id"),
        unique("dim_zone", "zone_id"),
        columns("dim_zone", "zone_id", "greenhouse_id", crop_type=schemas.CROP_TYPES),
        refers("dim_zone", "greenhouse_id", "dim_greenhouse"),
        unique("dim_sensor", "sensor_id"),
        columns("dim_sensor", "sensor_id", "zone_id", sensor_type=schemas.SENSOR_TYPES),
        refers("dim_sensor", "zone_id", "dim_zone"),
        unique("dim_date", "date_day"),
        columns("dim_date", "date_day"),
        unique("fact_sensor_readings", "reading_id"),
        columns("fact_sensor_readings", "reading_id", "sensor_id", "reading_timestamp"),
        refers("fact_sensor_readings", "sensor_id", "dim_sensor"),
        columns("daily_greenhouse_metrics", "greenhouse_id", "metric_date"),
        refers("daily_greenhouse_metrics", "greenhouse_id", "dim_greenhouse"),
        columns("hourly_zone_metrics", "zone_id", sensor_type=schemas.SENSOR_TYPES),
        refers("hourly_zone_metrics", "zone_id", "dim_zone"),
        unique("sensor_health_summary", "sensor_id"),
        columns("sensor_health_summary", "sensor_id"),
    ]


def refresh(sources: Sources, out: str, as_of: Instant, dates: list | None = None) -> dict[str, int]:
    """The whole refresh; raises when a constraint of the marts is violated.

    With ``dates`` only these are refreshed.
    """
    counts = refresh_staging(sources, out, dates) | {
        f"marts.{name}": rows for name, rows in refresh_marts(sources, out, as_of, dates).items()
    }
    quality.enforce(mart_checks(sources.readings.sparkSession, out))
    return counts


def refresh_changed(sources: Sources, changed: DataFrame, out: str, as_of: Instant) -> dict[str, int]:
    """Refresh what the ``changed`` readings (sensor, time), already among the sources, can alter.

    Their dates and those that the next frames reach are computed anew from the readings, never
    from earlier results, so a refresh that was cut off is simply run again with the same
    changes. Other dates keep their files. A change of the sensors, zones or bounds needs a
    full ``refresh``. The counts are those of the refreshed dates.
    """
    spark = sources.readings.sparkSession
    return refresh(sources, out, as_of, changed_dates(_days_table(spark, out), changed))
