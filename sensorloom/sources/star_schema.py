"""Sensor tables derived from the star-schema Parquet tables in a directory.

Readings come from ``events`` (one sensor per user), the hierarchy from the users seen,
sites from ``region``, lifecycle rows from event types and yield records from
``lineitem``. Everything is a projection or an aggregate of the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.time import Instant, instant
from sensorloom.operators.joins import lookup_join

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double"
    ),
}
_EPOCH = "TIMESTAMP '2024-01-01 00:00:00Z'"
_ZONE = "CAST(floor(user_id / 6) AS INT)"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def events(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def greenhouses(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "region").selectExpr(
        "r_regionkey AS id",
        "r_name AS name",
        "concat('site-', r_regionkey) AS location",
        "'active' AS status",
        f"{_EPOCH} AS created_at",
        f"{_EPOCH} AS updated_at",
    )


def zones(spark: SparkSession, directory: str) -> DataFrame:
    ids = events(spark, directory).selectExpr(f"{_ZONE} AS id").distinct()
    return ids.selectExpr(
        "id",
        "id % 5 AS greenhouse_id",
        "concat('Zone ', id) AS name",
        "CASE id % 4 WHEN 0 THEN 'tomato' WHEN 1 THEN 'cucumber' WHEN 2 THEN 'lettuce' ELSE 'pepper' END AS crop_type",
        "CAST(18 AS DECIMAL(6,2)) AS target_temperature_min",
        "CAST(26 AS DECIMAL(6,2)) AS target_temperature_max",
        "CAST(60 AS DECIMAL(5,2)) AS target_humidity_min",
        "CAST(80 AS DECIMAL(5,2)) AS target_humidity_max",
        "CAST(55 AS DECIMAL(5,2)) AS target_soil_moisture_min",
        "CAST(75 AS DECIMAL(5,2)) AS target_soil_moisture_max",
    )


def sensors(spark: SparkSession, directory: str, seen_before: Instant | None = None) -> DataFrame:
    """One sensor per user; ``seen_before`` gives the inventory known at that time."""
    seen = events(spark, directory)
    if seen_before is not None:
        seen = seen.filter(F.col("ts") < instant(seen_before))
    return seen.select("user_id").distinct().selectExpr(
        "CAST(user_id AS INT) AS id",
        f"{_ZONE} AS zone_id",
        "CASE user_id % 6 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' WHEN 2 THEN 'soil_moisture' "
        "WHEN 3 THEN 'light' WHEN 4 THEN 'co2' ELSE 'irrigation' END AS sensor_type",
        "CASE user_id % 6 WHEN 0 THEN 'C' WHEN 3 THEN 'lux' WHEN 4 THEN 'ppm' WHEN 5 THEN 'L/min' ELSE '%' END AS unit",
        "'active' AS status",
        f"{_EPOCH} AS created_at",
    )


def readings(spark: SparkSession, directory: str) -> DataFrame:
    scale = "CASE user_id % 6 WHEN 0 THEN 0.5D WHEN 3 THEN 400D WHEN 4 THEN 20D WHEN 5 THEN 0.1D ELSE 1D END"
    return events(spark, directory).selectExpr(
        "event_id AS id",
        "CAST(user_id AS INT) AS sensor_id",
        "ts AS timestamp",
        f"CAST(value * {scale} AS DECIMAL(12,4)) AS value",
    )


def repeated_readings(spark: SparkSession, directory: str) -> DataFrame:
    """Readings on an hourly clock, so that one sensor reports a time more than once."""
    return readings(spark, directory).withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def _with_newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Flag the newest row per key; the per-key winner is found by partial aggregation."""
    newest = rows.groupBy(*keys).agg(F.max_by("event_id", "ts").alias("newest_id"))
    joined = lookup_join(rows, newest, keys)
    return joined.withColumn("is_newest", F.expr("event_id = newest_id"))


def alerts(spark: SparkSession, directory: str) -> DataFrame:
    errors = events(spark, directory).filter("event_type = 'error'").selectExpr(
        "*",
        "CASE event_id % 3 WHEN 0 THEN 'threshold_high' WHEN 1 THEN 'threshold_low' ELSE 'anomaly' END AS alert_type",
    )
    states = "CASE WHEN NOT is_newest THEN 'resolved' WHEN event_id % 2 = 0 THEN 'open' ELSE 'acknowledged' END AS status"
    rows = _with_newest(errors, ["user_id", "alert_type"]).selectExpr("*", states)
    return rows.selectExpr(
        "event_id AS id",
        f"{_ZONE} % 5 AS greenhouse_id",
        f"{_ZONE} AS zone_id",
        "CAST(user_id AS INT) AS sensor_id",
        "alert_type",
        "CASE WHEN value >= 100 THEN 'critical' WHEN value >= 10 THEN 'warning' ELSE 'info' END AS severity",
        "status",
        "concat('alert from sensor ', user_id) AS message",
        "CAST(value AS DECIMAL(12,4)) AS value",
        "'n/a' AS threshold",
        "ts AS created_at",
        "CASE WHEN status = 'acknowledged' THEN ts END AS acknowledged_at",
        "CASE WHEN status = 'resolved' THEN ts END AS resolved_at",
    )


def recommendations(spark: SparkSession, directory: str) -> DataFrame:
    purchases = events(spark, directory).filter("event_type = 'purchase'").selectExpr(
        "*",
        f"{_ZONE} AS zone_id",
        "CASE event_id % 7 WHEN 0 THEN 'irrigation_needed' WHEN 1 THEN 'temperature_high' "
        "WHEN 2 THEN 'temperature_low' WHEN 3 THEN 'humidity_high_risk' WHEN 4 THEN 'co2_out_of_range' "
        "WHEN 5 THEN 'anomaly_review' ELSE 'yield_risk' END AS recommendation_type",
    )
    states = "CASE WHEN is_newest THEN 'open' WHEN event_id % 2 = 0 THEN 'dismissed' ELSE 'completed' END AS status"
    rows = _with_newest(purchases, ["zone_id", "recommendation_type"]).selectExpr("*", states)
    return rows.selectExpr(
        "event_id AS id",
        "zone_id % 5 AS greenhouse_id",
        "zone_id",
        "CAST(user_id AS INT) AS sensor_id",
        "recommendation_type",
        "CASE WHEN value >= 150 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS priority",
        "status",
        "concat('review zone ', zone_id) AS message",
        "'derived from a purchase event' AS reason",
        "ts AS created_at",
        "ts AS updated_at",
        "CASE WHEN status <> 'open' THEN ts END AS resolved_at",
    )


def order_lines(spark: SparkSession, directory: str) -> DataFrame:
    """What yield records are made of, one row per order line; repeated lines are folded by minimum."""
    return (
        table(spark, directory, "lineitem")
        .groupBy(F.expr("l_orderkey * 10 + l_linenumber AS record_id"))
        .agg(
            *[
                F.expr(f"min({source}) AS {name}")
                for name, source in {
                    "part": "l_partkey",
                    "supp": "l_suppkey",
                    "quantity": "l_quantity",
                    "price": "l_extendedprice",
                    "discount": "l_discount",
                    "tax": "l_tax",
                }.items()
            ]
        )
    )


def yield_records(spark: SparkSession, directory: str) -> DataFrame:
    """One record per order line; repeated lines of an order are folded by minimum."""
    return records_of(order_lines(spark, directory))


def records_of(lines: DataFrame, *others: str) -> DataFrame:
    """The records of folded order lines, with other columns of theirs where wanted."""
    return lines.selectExpr(
        "record_id",
        "CASE part % 4 WHEN 0 THEN 'Tomato' WHEN 1 THEN 'Cucumber' WHEN 2 THEN 'Lettuce' ELSE 'Pepper' END AS crop_type",
        "15D + quantity * 0.3D AS avg_temperature_C",
        "9D + quantity * 0.3D AS min_temperature_C",
        "20D + quantity * 0.3D + tax * 10 AS max_temperature_C",
        "CAST(60 + supp % 30 AS DOUBLE) AS humidity_percent",
        "600D + price / 250 AS co2_ppm",
        "10000D + price / 4 AS light_intensity_lux",
        "10D + discount * 40 AS photoperiod_hours",
        "CAST(2 + part % 7 AS DOUBLE) AS irrigation_mm",
        "CAST(60 + part % 140 AS DOUBLE) AS fertilizer_N_kg_ha",
        "CAST(30 + supp % 70 AS DOUBLE) AS fertilizer_P_kg_ha",
        "CAST(40 + record_id % 110 AS DOUBLE) AS fertilizer_K_kg_ha",
        "tax * 100 AS pest_severity",
        "5.5D + discount * 20 AS soil_pH",
        "CAST(60 + record_id % 61 AS INT) AS days_to_maturity",
        "3D + CASE part % 4 WHEN 0 THEN 2D WHEN 1 THEN 1D WHEN 2 THEN 0D ELSE 0.5D END "
        "- abs(15D + quantity * 0.3D - 23) / 10 + price / 200000 - tax * 8 - quantity * tax * 0.15D "
        "+ CAST(record_id * 7919 % 1000 AS DOUBLE) / 2500 - 0.2D AS yield_kg_per_m2",
        *others,
    )


def reading_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Readings as the JSON text a device would send.

    Error events carry no value and purchase events an unexpected field, so the documents
    hold every way a reading can be malformed that the schema knows.
    """
    return events(spark, directory).selectExpr(
        "event_id AS seq",
        "to_json(named_struct('sensor_id', user_id, "
        "'timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"), "
        "'value', CASE WHEN event_type <> 'error' THEN value END, "
        "'props', CASE WHEN event_type = 'purchase' THEN props END)) AS raw",
    )
