import json
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorloom.operators import ingestion
from tests.conftest import DAY, minutes

TIME = "2020-06-01T00:00:00Z"


def parse(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq long, raw string")
    return ingestion.parse_readings(frame).orderBy("seq").collect()


def test_valid_readings(spark):
    rows = parse(
        spark,
        {"sensor_id": 1, "timestamp": TIME, "value": 1.5},
        {"sensor_id": "2", "timestamp": "2020-06-01T02:00:00+02:00", "value": "7"},
        {"sensor_id": 3.0, "timestamp": 1590969600, "value": 0},
        {"sensor_id": 4, "timestamp": 1590969600000, "value": -1e3},
    )
    assert [r.problem for r in rows] == [None] * 4
    assert [r.sensor_id for r in rows] == [1, 2, 3, 4]
    assert {r.timestamp.astimezone(timezone.utc) for r in rows} == {DAY}
    assert [r.value for r in rows] == [1.5, 7.0, 0.0, -1000.0]


@pytest.mark.parametrize(
    ("document", "problem"),
    [
        ({"sensor_id": 1, "timestamp": TIME}, "value"),
        ({"sensor_id": 1, "value": 1.0}, "timestamp"),
        ({"timestamp": TIME, "value": 1.0}, "sensor_id"),
        ({"sensor_id": 0, "timestamp": TIME, "value": 1.0}, "sensor_id"),
        ({"sensor_id": -4, "timestamp": TIME, "value": 1.0}, "sensor_id"),
        ({"sensor_id": 1.5, "timestamp": TIME, "value": 1.0}, "sensor_id"),
        ({"sensor_id": 1, "timestamp": "yesterday", "value": 1.0}, "timestamp"),
        ({"sensor_id": 1, "timestamp": TIME, "value": "much"}, "value"),
        ({"sensor_id": 1, "timestamp": TIME, "value": None}, "value"),
        ({"sensor_id": 1, "timestamp": TIME, "value": 1.0, "unit": "C"}, "unexpected field"),
        ({"sensor_id": 1, "timestamp": "12:30:00", "value": 1.0}, "timestamp"),
        ({"sensor_id": 1, "timestamp": TIME, "value": "NaN"}, "value"),
        ({"sensor_id": 1, "timestamp": TIME, "value": 1e12}, "value"),
        ([1, 2], "not an object"),
        ("{broken", "not an object"),
    ],
)
def test_malformed_readings(spark, document, problem):
    (row,) = parse(spark, document)
    assert row.problem == problem


def test_no_reading_hides_behind_another(spark):
    one = json.dumps({"sensor_id": 1, "timestamp": TIME, "value": 1.0})
    texts = [f"{one} {one}", f"{one} trailing", f"{one},", one[:-1] + ', "value": 2.0}', f" {one} "]
    frame = spark.createDataFrame(list(enumerate(texts)), "seq long, raw string")
    problems = {r.seq: r.problem for r in ingestion.parse_readings(frame).collect()}
    assert problems == {0: "not one document", 1: "not one document", 2: "not one document", 3: "not one document", 4: None}


def batches(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    frame = spark.createDataFrame(list(enumerate(texts)), "batch_id long, raw string")
    return ingestion.parse_batches(frame, most_readings=500)


def test_batches_are_taken_or_refused_whole(spark):
    good = {"sensor_id": 1, "timestamp": TIME, "value": 1.0}
    bad = {"sensor_id": 1, "timestamp": TIME}
    parsed = batches(
        spark,
        {"readings": [good, {**good, "sensor_id": 2}]},
        {"readings": [good, bad]},
        {"readings": []},
        {"rows": [good]},
        {"readings": [good], "extra": 1},
        {"readings": "nothing"},
        {"readings": [good] * 501},
        {"readings": [good] * 500},
    )
    assert {r.batch_id: r.n for r in ingestion.accepted(parsed).groupBy("batch_id").count().withColumnRenamed("count", "n").collect()} == {0: 2, 7: 500}
    problems = {r.batch_id: r.problem for r in ingestion.malformed(parsed).select("batch_id", "problem").distinct().collect()}
    assert problems == {
        1: "value", 3: "no readings", 4: "unexpected field", 5: "readings is not a list", 6: "more than 500 readings",
    }


def counts(fleet, batch, stored=()):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"))
    rows = fleet.readings(*batch).withColumnRenamed("id", "seq")
    return tuple(ingestion.ingest_stats(rows, sensors, fleet.readings(*stored)).first())


def test_counts(fleet):
    ten = [(1, minutes(i), float(i)) for i in range(10)]
    assert counts(fleet, ten) == (10, 10, 0, 0)
    assert counts(fleet, [(1, DAY, 1.0), (8, DAY, 1.0), (9, DAY, 1.0)]) == (3, 1, 2, 0)
    assert counts(fleet, ten[:5], ten) == (5, 0, 0, 5)
    assert counts(fleet, []) == (0, 0, 0, 0)
    assert counts(fleet, [(1, DAY, 1.0), (1, DAY, 2.0), (1, DAY, 3.0), (2, DAY, 4.0)]) == (4, 2, 0, 2)


def test_the_first_copy_is_inserted(fleet):
    sensors = fleet.sensors((1, 1, "temperature"))
    batch = fleet.readings((5, 1, DAY, 2.0), (4, 1, DAY, 1.0), (6, 1, DAY, 3.0)).withColumnRenamed("id", "seq")
    (row,) = ingestion.insertable(batch, sensors, fleet.readings()).collect()
    assert (row.sensor_id, float(row.value), row.seq) == (1, 1.0, 4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 4), st.integers(1, 6)), max_size=25),
    st.lists(st.tuples(st.integers(1, 2), st.integers(1, 6)), max_size=6, unique=True),
)
def test_every_reading_is_counted_once(fleet, batch, stored):
    received, inserted, rejected, duplicates = counts(
        fleet, [(s, minutes(m), 1.0) for s, m in batch], [(s, minutes(m), 1.0) for s, m in stored]
    )
    known = {(s, m) for s, m in batch if s <= 2}
    assert received == len(batch) == inserted + rejected + duplicates
    assert rejected == sum(s > 2 for s, _ in batch)
    assert inserted == len(known - set(stored))


def test_naive_times_are_utc(spark):
    (row,) = parse(spark, {"sensor_id": 1, "timestamp": "2020-06-01T10:00:00", "value": 1})
    assert row.timestamp.astimezone(timezone.utc) == datetime(2020, 6, 1, 10, tzinfo=timezone.utc)
