import random
import statistics
from dataclasses import replace
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorloom.operators import alerts, anomaly
from sensorloom.settings import DEFAULTS
from tests.conftest import DAY, NOON, hours, minutes, settled


@pytest.fixture(scope="module")
def site(fleet):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"), (3, 1, "co2"), (4, 1, "light"))
    return sensors, fleet.zones(1)


def evaluate(site, readings):
    return alerts.alert_evaluation(*site, readings, NOON)


def step(site, fleet, existing, *rows):
    """One evaluation and the next snapshot."""
    changes = alerts.alert_reconcile(existing, evaluate(site, fleet.readings(*rows)), NOON)
    return settled(changes), settled(alerts.apply_alert_changes(existing, changes))


def test_threshold_texts(site, fleet):
    readings = fleet.readings((1, minutes(2), 22.0), (1, minutes(1), 32.5), (2, minutes(1), 58.0), (3, minutes(1), 3000.0), (4, minutes(1), 9.0))
    found = {r.sensor_id: r for r in alerts.fired(alerts.threshold_evaluation(*site, readings, NOON)).collect()}
    assert set(found) == {1, 2, 3}
    assert found[1].alert_type == "threshold_high" and found[1].severity == "critical"
    assert found[1].message == "Temperature 32.5C is above target 26.0C"
    assert found[1].threshold == "18.0–26.0 C"
    assert found[2].alert_type == "threshold_low" and found[2].severity == "warning"
    assert found[2].message == "Humidity 58.0% is below target 60.0%"
    assert found[3].message == "Co2 3000.0ppm is above target 1500.0ppm"
    assert found[3].threshold == "400.0–1500.0 ppm"


def test_only_the_latest_reading_counts_and_one_alert_opens(site, fleet):
    changes, snapshot = step(site, fleet, fleet.alerts(), (1, minutes(3), 40.0), (1, minutes(2), 41.0), (1, minutes(1), 42.0))
    (row,) = snapshot.collect()
    assert (row.status, row.alert_type, row.severity, float(row.value)) == ("open", "threshold_high", "critical", 42.0)
    again, same = step(site, fleet, snapshot, (1, minutes(1), 42.0))
    assert [r.action for r in again.collect()] == ["update"]
    assert same.collect() == snapshot.collect()


def test_back_to_normal_resolves_and_the_other_side_takes_over(site, fleet):
    existing = fleet.alerts({"sensor_id": 1, "alert_type": "threshold_high"})
    _, resolved = step(site, fleet, existing, (1, minutes(1), 22.0))
    (row,) = resolved.collect()
    assert row.status == "resolved" and row.resolved_at is not None
    changes, snapshot = step(site, fleet, existing, (1, minutes(1), 5.0))
    assert {(r.alert_type, r.action) for r in changes.collect()} == {("threshold_high", "resolve"), ("threshold_low", "insert")}
    assert snapshot.count() == 2


def test_acknowledged_stays_acknowledged_and_unevaluated_stays(site, fleet):
    existing = fleet.alerts(
        {"sensor_id": 1, "status": "acknowledged", "acknowledged_at": DAY},
        {"sensor_id": 2, "alert_type": "threshold_low"},
        {"sensor_id": 1, "alert_type": "anomaly"},
        {"sensor_id": 1, "alert_type": "threshold_low", "status": "resolved", "resolved_at": DAY},
    )
    changes, snapshot = step(site, fleet, existing, (1, hours(30), 40.0))
    found = {(r.sensor_id, r.alert_type): r for r in changes.collect()}
    assert found[1, "threshold_high"].action == "update"
    assert found[1, "threshold_high"].status == "acknowledged"
    assert found[2, "threshold_low"].action == "keep"
    # its last reading is older than a day, so the anomaly type was not evaluated
    assert found[1, "anomaly"].action == "keep"
    assert snapshot.count() == 4


def test_an_unusable_range_resolves(fleet):
    site = fleet.sensors((1, 1, "temperature")), fleet.zones(1, temperature=(20, 20))
    changes, _ = step(site, fleet, fleet.alerts({"sensor_id": 1}), (1, minutes(1), 30.0))
    assert [r.action for r in changes.collect()] == ["resolve"]


def test_readings_of_a_wrong_clock_keep_nothing_firing(site, fleet):
    readings = fleet.readings((1, NOON + timedelta(days=3_650), 90.0), (1, minutes(1), 22.0))
    assert not any(r.fired for r in alerts.threshold_evaluation(*site, readings, NOON).collect())
    soon = fleet.readings((1, NOON + timedelta(hours=23), 90.0), (1, minutes(1), 22.0))
    assert any(r.fired for r in alerts.threshold_evaluation(*site, soon, NOON).collect())


def test_a_zone_without_targets_is_not_evaluated(fleet):
    site = fleet.sensors((1, 1, "temperature")), fleet.zones(1, temperature=(None, 26))
    assert alerts.threshold_evaluation(*site, fleet.readings((1, minutes(1), 90.0)), NOON).count() == 0


def test_transitions(fleet, spark):
    existing = fleet.alerts({}, {"status": "acknowledged"}, {"status": "resolved"}, {}, {})
    later = NOON + timedelta(minutes=1)
    actions = spark.createDataFrame(
        [(1, "acknowledge", NOON), (2, "acknowledge", NOON), (2, "resolve", NOON), (3, "resolve", NOON),
         (3, "acknowledge", NOON), (4, "acknowledge", later), (4, "resolve", NOON), (77, "resolve", NOON)],
        "id long, action string, at timestamp",
    )
    rows = {r.id: r for r in alerts.alert_transitions(existing, actions).collect()}
    assert [rows[i].status for i in range(1, 6)] == ["acknowledged", "resolved", "resolved", "resolved", "open"]
    assert rows[1].acknowledged_at is not None and rows[2].acknowledged_at is None
    assert rows[4].acknowledged_at is None and rows[3].resolved_at is None
    assert [r.id for r in alerts.unknown_ids(existing, actions).collect()] == [77]


def detect_by_hand(values, window=60, threshold=4.0):
    """Newest first."""
    if len(values) < 10:
        return False, None
    history = values[1 : window + 1]
    std = statistics.pstdev(history)
    z = 0.0 if std < 1e-9 else (values[0] - statistics.fmean(history)) / std
    return abs(z) > threshold, z


def test_detector_against_its_definition(fleet):
    rng = random.Random(5)
    series = {
        1: [60.0] + [rng.gauss(22, 1) for _ in range(80)],
        2: [90.0] + [22.0] * 30,
        3: [90.0] + [22.0, 23.0] * 4,
        4: [22.0] + [rng.gauss(22, 1) for _ in range(9)],
        5: [-40.0] + [rng.gauss(22, 1) for _ in range(59)],
    }
    series = {s: [round(v, 4) for v in vs] for s, vs in series.items()}
    rows = [(s, minutes(i + 1), v) for s, vs in series.items() for i, v in enumerate(vs)]
    found = {r.sensor_id: r for r in anomaly.anomaly_latest(fleet.readings(*rows), NOON).collect()}
    for sensor, values in series.items():
        flag, z = detect_by_hand(values[:60])
        assert found[sensor].is_anomaly == flag
        assert found[sensor].z_score == (None if z is None else pytest.approx(z))
    assert found[1].is_anomaly and found[5].is_anomaly
    assert not found[2].is_anomaly and found[2].z_score == 0.0
    assert found[3].current_value is None and found[3].mean is None


def test_readings_before_the_cutoff_are_not_scored(fleet):
    rows = [(1, hours(25), 99.0)] + [(1, hours(26 + i), 20.0 + i % 2) for i in range(20)]
    assert anomaly.anomaly_latest(fleet.readings(*rows), NOON).count() == 0


def test_anomaly_alert_text_and_resolution(site, fleet):
    rows = [(1, minutes(1), 60.0)] + [(1, minutes(2 + i), 20.0 + i % 2) for i in range(20)]
    fired = alerts.fired(alerts.anomaly_evaluation(*site, fleet.readings(*rows), NOON)).collect()
    (row,) = fired
    assert row.message == "Temperature 60.0C is a statistical anomaly (z=79.00)"
    assert (row.severity, row.threshold, row.value) == ("warning", "z>4.0", 60.0)
    existing = fleet.alerts({"sensor_id": 1, "alert_type": "anomaly"})
    calm = [(1, minutes(1 + i), 20.0 + i % 2) for i in range(20)]
    changes, _ = step(site, fleet, existing, *calm)
    assert [r.action for r in changes.filter("alert_type = 'anomaly'").collect()] == ["resolve"]


def test_a_plugged_detector_is_used(fleet):
    def every(recent):
        return recent.filter("rank = 1").selectExpr(
            "sensor_id", "true AS is_anomaly", "9.0D AS z_score", "value AS current_value", "0.0D AS mean", "1.0D AS std"
        )

    found = anomaly.anomaly_latest(fleet.readings((1, minutes(1), 3.0)), NOON, DEFAULTS, every).collect()
    assert [(r.sensor_id, r.is_anomaly) for r in found] == [(1, True)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 500), st.integers(-500, 4000)), max_size=30, unique_by=lambda r: r[:2]))
def test_reconciling_twice_changes_nothing(site, fleet, rows):
    readings = fleet.readings(*[(s, minutes(m), v / 10) for s, m, v in rows])
    existing = fleet.alerts({"sensor_id": 1}, {"sensor_id": 2, "alert_type": "threshold_low", "status": "acknowledged"})
    lively = replace(DEFAULTS, anomaly_z=1.0)
    evaluation = settled(alerts.alert_evaluation(*site, readings, NOON, lively))
    once = settled(alerts.apply_alert_changes(existing, alerts.alert_reconcile(existing, evaluation, NOON)))
    twice = alerts.apply_alert_changes(once, alerts.alert_reconcile(once, evaluation, NOON))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    active = [(r.sensor_id, r.alert_type) for r in once.filter("status <> 'resolved'").collect()]
    assert len(active) == len(set(active))
