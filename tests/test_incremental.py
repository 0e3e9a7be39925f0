"""Refreshing only what changed readings reach."""

import os
import random
from datetime import timedelta

from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators import reach, rollups
from sensorloom.plans import batch
from tests.conftest import DAY, NOON

TABLES = {
    "staging/sensor_readings_clean": None, "staging/hourly_zone_metrics": "std_value", "staging/sensor_days": None,
    "marts/fact_sensor_readings": None, "marts/hourly_zone_metrics": "std_value", "marts/daily_greenhouse_metrics": "std_value",
    "marts/sensor_health_summary": None, "marts/dim_date": None,
}
LATER = NOON + timedelta(days=30)


def series():
    """Two sensors over twelve days, one of them with a pause, as (id, sensor, time, value)."""
    rng, rows = random.Random(5), []
    for i in range(240):
        rows.append((1, DAY + timedelta(minutes=70 * i), 20 + i % 3 + (15 if i % 41 == 40 else 0)))
        if not 90 < i < 170:
            rows.append((2, DAY + timedelta(minutes=71 * i), 60 + i % 4 + (30 if i % 53 == 52 else 0)))
    rng.shuffle(rows)
    return [(i, *row) for i, row in enumerate(rows, 1)]


def sources(fleet, rows):
    return batch.Sources(
        fleet.greenhouses(1), fleet.zones(1, 2), fleet.sensors((1, 1, "temperature"), (2, 2, "humidity")),
        fleet.readings(*rows),
    )


def contents(spark, out):
    found = {}
    for name, rounded in TABLES.items():
        frame = spark.read.parquet(f"{out}/{name}")
        frame = frame.withColumn(rounded, F.round(rounded, 9)) if rounded else frame
        found[name] = sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    return found


def files_of(out, table):
    return {
        os.path.join(folder, name) for folder, _, names in os.walk(f"{out}/{table}") for name in names if name.endswith(".parquet")
    }


def test_increments_equal_one_full_refresh(spark, fleet, tmp_path):
    rows = series()
    late = [r for r in rows if r[0] % 10 == 0]
    # new copies of stored readings, an impossible copy, a reading before all others and an unknown sensor
    last = len(rows)
    late += [(last + 1, *rows[3][1:3], rows[3][3] + 9), (last + 2, *rows[4][1:3], 999.0)]
    late += [(last + 3, 1, DAY - timedelta(days=400), 21.0), (last + 4, 77, NOON, 1.0), (last + 5, 1, NOON, None)]
    steps = [late[:6], late[6:30], late[30:]]
    out, have = str(tmp_path / "steps"), [r for r in rows if r[0] % 10]
    batch.refresh(sources(fleet, have), out, LATER)
    for step in steps:
        have = have + step
        changed = fleet.readings(*step).select("sensor_id", "timestamp")
        batch.refresh_changed(sources(fleet, have), changed, out, LATER)
    whole = str(tmp_path / "whole")
    batch.refresh(sources(fleet, have), whole, LATER)
    assert contents(spark, out) == contents(spark, whole)
    # the same changes once more leave the same rows
    batch.refresh_changed(sources(fleet, have), changed, out, LATER)
    assert contents(spark, out) == contents(spark, whole)
    # the health from days is the health from the fact
    fact = spark.read.parquet(f"{whole}/marts/fact_sensor_readings").drop("reading_date")
    health = rollups.sensor_health_summary(fact, LATER)
    written = spark.read.parquet(f"{whole}/marts/sensor_health_summary")
    assert sorted(map(str, health.collect())) == sorted(map(str, written.select(*health.columns).collect()))


def test_dates_out_of_reach_keep_their_files(spark, fleet, tmp_path):
    rows, out = series(), str(tmp_path)
    batch.refresh(sources(fleet, rows), out, LATER)
    table = "staging/sensor_readings_clean"
    before = files_of(out, table)
    extra = (10_000, 2, DAY + timedelta(days=6), 61.0)  # in the pause of sensor 2
    changed = fleet.readings(extra).select("sensor_id", "timestamp")
    dates = batch.changed_dates(spark.read.parquet(f"{out}/staging/sensor_days"), changed)
    batch.refresh_changed(sources(fleet, [*rows, extra]), changed, out, LATER)
    written = {path.split("reading_date=")[1][:10] for path in files_of(out, table) - before}
    assert written == {str(d) for d in dates}
    assert str((DAY + timedelta(days=5)).date()) not in written and len(before & files_of(out, table)) > 0


def test_reach_counts_readings_not_days(spark):
    days = spark.createDataFrame(
        [(1, DAY.date() + timedelta(days=i), n, 0, NOON) for i, n in enumerate([30, 30, 28, 1, 5, 100, 3])],
        "sensor_id int, reading_date date, rows long, outliers long, last_seen_at timestamp",
    )
    def numbers(frame):
        return sorted((r.reading_date - DAY.date()).days for r in frame.collect())

    changed = spark.createDataFrame([(1, NOON + timedelta(days=1)), (9, NOON), (None, NOON), (1, None)], "sensor_id int, timestamp timestamp")
    found = reach.changed_days(days, changed)
    assert numbers(found.filter("sensor_id = 1")) == [1, 2, 3, 4, 5]  # 34 readings lie between days 1 and 5, 134 before day 6
    assert numbers(found.filter("sensor_id = 9")) == [0]
    assert numbers(reach.days_to_read(days, [DAY.date() + timedelta(days=3)])) == [0, 1, 2]  # 58 readings on days 1 and 2
    assert numbers(reach.days_to_read(days, [DAY.date() + timedelta(days=4)])) == [1, 2, 3]  # 59 on days 1 to 3


def test_no_change_refreshes_nothing(spark, fleet, tmp_path):
    out = str(tmp_path)
    batch.refresh(sources(fleet, series()), out, LATER)
    before = contents(spark, out)
    counts = batch.refresh_changed(sources(fleet, series()), spark.createDataFrame([], schemas.READINGS), out, LATER)
    assert counts["sensor_readings_clean"] == 0 and contents(spark, out) == before
