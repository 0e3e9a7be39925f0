"""Strict validation of incoming readings and idempotent, fully counted insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.joins import lookup_join

FIELDS = ("sensor_id", "timestamp", "value")
_INTEGRAL = r"^[+-]?\d+(\.0+)?$"
_NUMBER = r"^[+-]?\d+(\.\d+)?$"
_DATED = r"^\d{4}-\d{2}-\d{2}"
# Readings are stored with twelve digits, four of them decimals.
STORED_VALUE = "decimal(12,4)"
_BELOW = 99_999_999.99995
# Fixed value: unix numbers beyond this are milliseconds, smaller ones seconds.
_MILLISECONDS_FROM = 2e10


def _whole_number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_INTEGRAL)), text.try_cast("decimal(38,6)")).try_cast("int")


def _time(text: Column) -> Column:
    number = F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))
    seconds = F.when(F.abs(number) > _MILLISECONDS_FROM, number / 1000).otherwise(number)
    from_number = F.timestamp_micros((seconds * 1_000_000).try_cast("long"))
    dated = F.when(F.rlike(text, F.lit(_DATED)), text.try_cast("timestamp"))
    return F.when(number.isNotNull(), from_number).otherwise(dated)


def _storable(text: Column) -> Column:
    """A finite number the stored type can hold."""
    number = text.try_cast("double")
    return F.when(F.abs(number) < _BELOW, number)


def _one_document(raw: Column) -> Column:
    """Whether the text is exactly one JSON value without repeated keys.

    A parser that stops at the end of the first value is made to see the rest: what follows
    breaks the list or the object that is put around the text.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}")))
    return in_list.isNotNull() & in_object.isNotNull()


def parse_readings(documents: DataFrame) -> DataFrame:
    """One JSON reading per row (column ``raw``): typed fields and ``problem``, null when valid.

    A reading has exactly sensor_id > 0, timestamp and value, and is alone in its text: text
    after it, a second document or a repeated key refuse the whole text. The document is parsed once,
    into texts by field name, and cast with ``try_cast``: a bad document becomes a row with
    a problem, not an error.
    """
    fields = F.col("_fields")
    typed = {
        "sensor_id": _whole_number(fields["sensor_id"]),
        "timestamp": _time(fields["timestamp"]),
        "value": _storable(fields["value"]),
    }
    known = ", ".join(f"'{name}'" for name in FIELDS)
    problem = F.expr(
        f"""CASE WHEN _fields IS NULL THEN 'not an object'
        WHEN NOT _single THEN 'not one document'
        WHEN size(array_except(map_keys(_fields), array({known}))) > 0 THEN 'unexpected field'
        WHEN sensor_id IS NULL OR sensor_id <= 0 THEN 'sensor_id'
        WHEN timestamp IS NULL THEN 'timestamp'
        WHEN value IS NULL THEN 'value' END"""
    )
    parsed = documents.withColumns(
        {"_fields": F.from_json("raw", "map<string,string>"), "_single": _one_document(F.col("raw"))}
    )
    return parsed.withColumns(typed).withColumn("problem", problem).drop("_fields", "_single")


def parse_batches(documents: DataFrame, most_readings: int | None = None) -> DataFrame:
    """One JSON batch {"readings": [...]} per row: its readings in order, with ``problem``.

    A batch is accepted or refused whole: no other field, every reading valid, and no more
    than ``most_readings`` of them where a client contract sets such a bound. A refused batch keeps its rows, all marked with its problem.
    Expects ``batch_id`` and ``raw``.
    """
    only = F.array(F.lit("readings"))
    keys = F.json_object_keys("raw")
    items = F.from_json("raw", "readings array<string>")["readings"]
    problem = (
        F.when(keys.isNull() | (F.size(F.array_except(only, keys)) > 0), "no readings")
        .when(~_one_document(F.col("raw")), "not one document")
        .when(F.size(F.array_except(keys, only)) > 0, "unexpected field")
        .when(items.isNull(), "readings is not a list")
    )
    if most_readings is not None:
        problem = problem.when(F.size(items) > most_readings, f"more than {most_readings} readings")
    batches = documents.select("batch_id", F.coalesce(items, F.array()).alias("_items"), problem.alias("_batch_problem"))
    rows = batches.select("batch_id", "_batch_problem", F.posexplode_outer("_items").alias("seq", "raw"))
    read = parse_readings(rows).withColumn(
        "problem", F.when(F.col("seq").isNotNull(), F.col("problem"))
    )
    refused = read.groupBy("batch_id").agg(F.min("problem").alias("_reading_problem"))
    return read.join(refused, "batch_id").select(
        "batch_id", "seq", *FIELDS,
        F.coalesce("_batch_problem", "_reading_problem").alias("problem"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """Valid readings; the placeholder row of an empty batch is not one."""
    return parsed.filter("problem IS NULL AND sensor_id IS NOT NULL").drop("problem", "raw")


def malformed(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem IS NOT NULL")


def known_readings(batch: DataFrame, sensors: DataFrame) -> DataFrame:
    """The batch with ``known``: whether the sensor exists."""
    ids = sensors.select(F.col("id").alias("sensor_id")).withColumn("_found", F.lit(True))
    flagged = lookup_join(batch, ids, "sensor_id", "left")
    return flagged.withColumn("known", F.col("_found").isNotNull()).drop("_found")


def unknown_sensors(parsed: DataFrame, sensors: DataFrame) -> DataFrame:
    """Valid readings of sensors that do not exist, with that as their ``problem``."""
    valid = parsed.filter("problem IS NULL AND sensor_id IS NOT NULL")
    unknown = known_readings(valid, sensors).filter("NOT known").drop("known")
    return unknown.withColumn("problem", F.lit("unknown sensor"))


def distinct_readings(batch: DataFrame, sensors: DataFrame) -> DataFrame:
    """Readings of known sensors, one per sensor and time, with the number of copies.

    The copy with the lowest ``seq`` stays. Copies are folded by partial aggregation, so
    a reading sent a million times reaches the exchange as a few rows.
    """
    return (
        known_readings(batch, sensors)
        .filter("known")
        .groupBy("sensor_id", "timestamp")
        .agg(F.min_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("copies"), F.min("seq").alias("seq"))
    )


def on_dates_of(stored: DataFrame, readings: DataFrame) -> DataFrame:
    """The stored readings of the dates on which the other readings lie.

    The set of dates, at most one for each day of the calendar, is a scalar subquery over the
    partition column: partitions between two far dates are not read.
    """
    days = readings.select(F.to_date("timestamp").alias("day")).agg(F.collect_set("day")).scalar()
    return stored.filter(F.array_contains(days, F.col("reading_date")))


def match_stored(distinct: DataFrame, stored: DataFrame) -> DataFrame:
    """Mark the readings whose (sensor, time) is already stored.

    With a stored ``reading_date`` partition column only the batch's dates are scanned.
    """
    keys = ["sensor_id", "timestamp"]
    if "reading_date" in stored.columns:
        distinct = distinct.withColumn("reading_date", F.to_date("timestamp"))
        keys = ["reading_date", *keys]
        stored = on_dates_of(stored, distinct)
    present = stored.select(*keys).distinct().withColumn("_stored", F.lit(True))
    matched = distinct.join(present, keys, "left")
    return matched.withColumn("is_stored", F.col("_stored").isNotNull()).drop("_stored")


def insertable(batch: DataFrame, sensors: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows an insert adds: known sensor, first of its copies, not stored yet."""
    matched = match_stored(distinct_readings(batch, sensors), stored)
    fresh = matched.filter(~F.col("is_stored")).drop("is_stored", "copies")
    return fresh.withColumn("value", F.col("value").cast(STORED_VALUE))


def ingest_stats(batch: DataFrame, sensors: DataFrame, stored: DataFrame) -> DataFrame:
    """received = inserted + rejected + duplicates, as one row."""
    known = match_stored(distinct_readings(batch, sensors), stored)
    fresh = ~F.col("is_stored")
    valid = known.agg(
        F.lit(0).cast("long").alias("received"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("valid"),
        F.count_if(fresh).alias("inserted"),
    )
    received = batch.agg(F.count(F.lit(1)).alias("received"))
    totals = valid.unionByName(received, allowMissingColumns=True).agg(
        F.sum("received").alias("received"), F.sum("valid").alias("valid"), F.sum("inserted").alias("inserted")
    )
    return totals.select(
        "received",
        "inserted",
        (F.col("received") - F.col("valid")).alias("rejected"),
        (F.col("valid") - F.col("inserted")).alias("duplicates"),
    )
