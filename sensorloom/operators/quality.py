"""Data-quality checks; each returns one row (check, violations, passed)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.time import Instant, hours_before, minutes_before
from sensorloom.operators.cleaning import is_possible
from sensorloom.operators.joins import lookup_join
from sensorloom.schemas import ACTIVE_ALERT_STATUSES
from sensorloom.settings import DEFAULTS, GATED_TYPES, IMPOSSIBLE_BOUNDS


class QualityError(RuntimeError):
    """At least one check found violations."""


def _report(name: str, violations: Column, frame: DataFrame) -> DataFrame:
    counted = frame.agg(F.coalesce(violations, F.lit(0)).cast("long").alias("violations"))
    return counted.select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))


def fresh_readings(readings: DataFrame, as_of: Instant, minutes: int = DEFAULTS.freshness_minutes) -> DataFrame:
    """At least one reading in the last minutes."""
    recent = readings.filter(F.col("timestamp") >= minutes_before(as_of, minutes))
    return _report("fresh_readings", F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), recent)


def no_ingestion_gap(readings: DataFrame, as_of: Instant, hours: int = DEFAULTS.gap_hours) -> DataFrame:
    """The newest reading is at most this old; no reading at all is a violation."""
    newest = readings.agg(F.max("timestamp").alias("newest"))
    stale = F.coalesce(F.col("newest") < hours_before(as_of, hours), F.lit(True))
    return _report("no_ingestion_gap", F.count_if(stale), newest)


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups with more than one row."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def no_duplicates(readings: DataFrame) -> DataFrame:
    return _report("no_duplicates", F.count(F.lit(1)), duplicate_keys(readings, ["sensor_id", "timestamp"]))


def _unmatched(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child keys without a parent and how many rows hold each; counted before the join."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key"))
    return keys.agg(F.count(F.lit(1)).alias("rows")).join(
        parent.select(F.col(parent_column).alias("key")), "key", "left_anti"
    )


def no_orphans(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    return _report("no_orphans", F.sum("rows"), _unmatched(readings, "sensor_id", sensors, "id"))


def no_impossible_values(
    readings: DataFrame, sensors: DataFrame, types: Sequence[str] = GATED_TYPES
) -> DataFrame:
    """Raw values outside the possible range, for the gated sensor types."""
    gated = sensors.filter(F.col("sensor_type").isin(*types)).select(F.col("id").alias("sensor_id"), "sensor_type")
    bounds = {kind: IMPOSSIBLE_BOUNDS[kind] for kind in types}
    outside = F.col("value").isNotNull() & ~is_possible(F.col("sensor_type"), F.col("value").cast("double"), bounds)
    return _report("no_impossible_values", F.count_if(outside), lookup_join(readings, gated, "sensor_id"))


def unique(frame: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Values (or value tuples) that occur more than once; nulls do not count."""
    present = frame.na.drop(subset=list(columns))
    return _report(f"unique:{name}", F.count(F.lit(1)), duplicate_keys(present, columns))


def not_null(frame: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Nulls over all the columns, in one pass."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])
    return _report(f"not_null:{name}", nulls, frame)


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    return _report(f"relationships:{name}", F.sum("rows"), _unmatched(child, column, parent, parent_column))


def accepted_values(frame: DataFrame, column: str, values: Sequence[str], name: str) -> DataFrame:
    return _report(f"accepted_values:{name}", F.count_if(~F.col(column).isin(*values)), frame)


def column_checks(
    frame: DataFrame, name: str, required: Sequence[str] = (), domains: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Not-null and accepted-values checks of any number of columns in one scan, one row each."""
    counts = {f"not_null:{name}.{c}": F.count_if(F.col(c).isNull()) for c in required}
    counts |= {f"accepted_values:{name}.{c}": F.count_if(~F.col(c).isin(*values)) for c, values in (domains or {}).items()}
    totals = frame.agg(*(count.alias(f"n{i}") for i, count in enumerate(counts.values())))
    rows = [F.struct(F.lit(check).alias("check"), F.col(f"n{i}").alias("violations")) for i, check in enumerate(counts)]
    return totals.select(F.inline(F.array(*rows))).withColumn("passed", F.col("violations") == 0)


def ordered_targets(zones: DataFrame) -> DataFrame:
    """Target ranges whose minimum is not below the maximum."""
    wrong = [
        F.count_if(F.col(f"target_{kind}_min") >= F.col(f"target_{kind}_max"))
        for kind in ("temperature", "humidity", "soil_moisture")
    ]
    return _report("ordered_targets", reduce(lambda a, b: a + b, wrong), zones)


def one_active_alert(alerts: DataFrame) -> DataFrame:
    """No two open or acknowledged alerts for one sensor and type."""
    active = alerts.filter(F.col("status").isin(*ACTIVE_ALERT_STATUSES) & F.col("sensor_id").isNotNull())
    return _report("one_active_alert", F.count(F.lit(1)), duplicate_keys(active, ["sensor_id", "alert_type"]))


def one_open_recommendation(recommendations: DataFrame) -> DataFrame:
    """No two open recommendations for one site, zone and type."""
    opened = recommendations.filter("status = 'open'").withColumn("zone_id", F.coalesce("zone_id", F.lit(0)))
    keys = ["greenhouse_id", "zone_id", "recommendation_type"]
    return _report("one_open_recommendation", F.count(F.lit(1)), duplicate_keys(opened, keys))


def combine(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: Sequence[DataFrame]) -> None:
    """Run the checks as one job and raise on violations; one row per check comes back."""
    failed = [row for row in combine(checks).filter("NOT passed").collect()]
    if failed:
        raise QualityError("; ".join(f"{row['check']}: {row['violations']}" for row in failed))


def enforce_raw_gate(readings: DataFrame, sensors: DataFrame, as_of: Instant) -> None:
    """Freshness first; the other raw checks only run on data that is arriving."""
    enforce([fresh_readings(readings, as_of)])
    enforce([
        no_duplicates(readings),
        no_orphans(readings, sensors),
        no_impossible_values(readings, sensors),
        no_ingestion_gap(readings, as_of),
    ])
