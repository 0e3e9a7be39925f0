from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sensorloom.operators.recommend import candidates, context, lifecycle
from sensorloom.operators.recommend.rules import RULES, FrameRule, ZoneRule
from sensorloom.settings import DEFAULTS
from tests.conftest import DAY, NOON, hours, minutes, settled

SENSORS = ((1, 1, "temperature"), (2, 1, "humidity"), (3, 1, "soil_moisture"), (4, 1, "co2"))


def propose(fleet, rows=(), alerts=(), zones=None, predict=None, settings=DEFAULTS, rules=RULES):
    built = context.build_context(
        fleet.zones(1) if zones is None else zones, fleet.sensors(*SENSORS), fleet.readings(*rows), fleet.alerts(*alerts),
        NOON, predict, "v1", settings,
    )
    return {r.recommendation_type: r for r in candidates.recommendation_candidates(built, rules).collect()}


@pytest.mark.parametrize(
    ("sensor", "value", "kind", "priority"),
    [
        (3, 40.0, "irrigation_needed", "critical"),
        (3, 50.0, "irrigation_needed", "high"),
        (3, 20.0, "irrigation_needed", "critical"),
        (3, 65.0, None, None),
        (3, 55.0, None, None),
        (2, 85.0, "humidity_high_risk", "medium"),
        (2, 92.0, "humidity_high_risk", "high"),
        (2, 90.0, "humidity_high_risk", "high"),
        (2, 80.0, None, None),
        (4, 2500.0, "co2_out_of_range", "medium"),
        (4, 100.0, "co2_out_of_range", "medium"),
        (4, 800.0, None, None),
        (4, 1500.0, None, None),
    ],
)
def test_current_value_rules(fleet, sensor, value, kind, priority):
    found = propose(fleet, [(sensor, minutes(1), value), (sensor, minutes(2), 61.0)])
    assert {k: r.priority for k, r in found.items()} == ({kind: priority} if kind else {})


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        ([28.0] * 5, "temperature_high"),
        ([28.0] * 3, None),
        ([22.0, 28.0, 28.0, 28.0, 28.0], None),
        ([28.0, 22.0, 28.0, 28.0, 28.0, 28.0], None),
        ([28.0] * 5 + [20.0], "temperature_high"),
        ([10.0] * 5, "temperature_low"),
        ([26.0] * 5, None),
    ],
)
def test_sustained_temperature(fleet, values, kind):
    found = propose(fleet, [(1, minutes(1 + 2 * i), v) for i, v in enumerate(values)])
    assert set(found) == ({kind} if kind else set())


def test_texts(fleet):
    rows = [(1, minutes(1 + 2 * i), 28.5 + i / 10) for i in range(5)]
    rows += [(2, minutes(1), 92.25), (3, minutes(1), 40.0), (4, minutes(1), 2500.0)]
    found = propose(fleet, rows, zones=fleet.zones(1, crop="Tomato"), predict=lambda z: z.select("zone_id", F.lit(3.0).alias("predicted_yield")))
    assert found["temperature_high"].message == (
        "Zone 1 temperature has been above the crop target for the last ~8 minutes "
        "(avg 28.7C vs target 18C-26C). Increase ventilation."
    )
    assert found["temperature_high"].reason == "Last 5 temperature readings from sensor #1 were all above 26C."
    assert found["humidity_high_risk"].message == (
        "Humidity in Zone 1 is 92.25%, above the target maximum of 80%. Sustained high humidity increases fungal disease risk."
    )
    assert found["irrigation_needed"].message == (
        "Soil moisture in Zone 1 is 40%, below the target minimum of 55%. Irrigation is recommended."
    )
    assert found["irrigation_needed"].reason == (
        "Zone target for soil moisture is 55%-75%. Latest reading from sensor #3 (Soil Moisture) is 40%."
    )
    assert found["co2_out_of_range"].message == "CO2 in Zone 1 is 2500 ppm, above the acceptable range (400-1500 ppm)."
    assert found["yield_risk"].message == (
        "Current environmental trends in Zone 1 may reduce predicted yield to 3 kg/m2 (baseline 4.8 kg/m2)."
    )
    assert found["yield_risk"].reason == (
        "ML model v1 predicts yield 37.5% below the Tomato baseline under the zone's current averaged conditions."
    )
    assert found["yield_risk"].sensor_id is None


def test_yield_risk_needs_a_known_crop_and_a_low_prediction(fleet):
    def at(value):
        return lambda z: z.select("zone_id", F.lit(value).cast("double").alias("predicted_yield"))

    assert propose(fleet, predict=at(4.8 * 0.85)) == {}
    assert propose(fleet, predict=at(None)) == {}
    assert propose(fleet, zones=fleet.zones(1, crop="kale"), predict=at(0.1)) == {}
    assert set(propose(fleet, predict=at(0.1))) == {"yield_risk"}


def test_stale_readings_and_missing_targets_do_not_fire(fleet):
    assert propose(fleet, [(3, hours(2), 10.0)]) == {}
    assert propose(fleet, [(3, minutes(1), 10.0)], zones=fleet.zones(1, soil=(None, 75))) == {}
    assert propose(fleet) == {}


def test_anomaly_review_takes_the_highest_alert(fleet):
    alerts = [
        {"alert_type": "anomaly", "severity": "critical", "message": "first"},
        {"alert_type": "anomaly", "status": "acknowledged", "message": "second", "sensor_id": 2},
        {"alert_type": "anomaly", "status": "resolved", "message": "closed"},
        {"alert_type": "threshold_high"},
        {"alert_type": "anomaly", "zone_id": 7, "message": "elsewhere"},
    ]
    found = propose(fleet, alerts=alerts)
    assert set(found) == {"anomaly_review"}
    row = found["anomaly_review"]
    assert (row.priority, row.sensor_id, row.source_id) == ("medium", 2, 2)
    assert row.reason == "Open anomaly alert #2: second"
    assert row.message == "Statistical anomaly detected in Zone 1. Review recent readings and confirm sensor integrity."


def test_a_failing_rule_is_left_out(fleet):
    broken = (ZoneRule("broken", lambda c: "no_such_column"), FrameRule("worse", lambda c: 1 / 0))
    assert set(propose(fleet, [(3, minutes(1), 10.0)], rules=(*broken, *RULES))) == {"irrigation_needed"}


def run(fleet, existing, rows, zones=None, scope="greenhouse"):
    zones = fleet.zones(1) if zones is None else zones
    built = context.build_context(zones, fleet.sensors(*SENSORS), fleet.readings(*rows), fleet.alerts(), NOON)
    changes = lifecycle.recommendation_reconcile(
        existing, candidates.recommendation_candidates(built), built.zones, NOON, scope
    )
    return settled(changes), settled(lifecycle.apply_recommendation_changes(existing, changes))


def test_a_failing_rule_closes_nothing(fleet):
    _, opened = run(fleet, fleet.recommendations(), [(3, minutes(2), 30.0)])
    built = context.build_context(fleet.zones(1), fleet.sensors(*SENSORS), fleet.readings((3, minutes(1), 60.0)), fleet.alerts(), NOON)
    failing = [FrameRule("irrigation_needed", lambda c: 1 / 0), *(r for r in RULES if r.name != "irrigation_needed")]
    for rules, action in ((failing, "keep"), (RULES, "complete")):
        found = candidates.recommendation_candidates(built, rules)
        types = candidates.ready_rules(built, rules)[1]
        changes = lifecycle.recommendation_reconcile(opened, found, built.zones, NOON, types=types)
        assert [r.action for r in changes.collect()] == [action]


def test_open_update_complete(fleet):
    changes, first = run(fleet, fleet.recommendations(), [(3, minutes(2), 30.0)])
    assert [(r.action, r.status) for r in changes.collect()] == [("insert", "open")]
    assert lifecycle.reconcile_stats(changes).first().asDict() == {"produced": 1, "created": 1, "updated": 0, "closed": 0}
    changes, second = run(fleet, first, [(3, minutes(1), 50.0)])
    (row,) = second.collect()
    assert (row.status, row.priority) == ("open", "high")
    changes, third = run(fleet, second, [(3, minutes(1), 70.0)])
    assert lifecycle.reconcile_stats(changes).first().asDict() == {"produced": 0, "created": 0, "updated": 0, "closed": 1}
    assert [r.status for r in third.collect()] == ["completed"]


def test_closed_items_do_not_block_new_ones(fleet):
    existing = fleet.recommendations({"status": "dismissed"}, {"status": "completed"})
    _, after = run(fleet, existing, [(3, minutes(1), 30.0)])
    assert sorted(r.status for r in after.collect()) == ["completed", "dismissed", "open"]


def test_scope(fleet):
    existing = fleet.recommendations({"zone_id": 2}, {"zone_id": None}, {"greenhouse_id": 9, "zone_id": 90})
    wide, _ = run(fleet, existing, [])
    assert sorted(r.action for r in wide.collect()) == ["complete", "complete", "keep"]
    narrow, _ = run(fleet, existing, [], scope="zones")
    assert sorted(r.action for r in narrow.collect()) == ["keep", "keep", "keep"]
    with pytest.raises(ValueError):
        run(fleet, existing, [], scope="planet")


def test_transitions(fleet, spark):
    existing = fleet.recommendations({}, {}, {"status": "dismissed"}, {})
    actions = spark.createDataFrame(
        [(1, "dismiss", NOON), (1, "complete", hours(1)), (2, "dismiss", NOON), (3, "complete", NOON)],
        "id long, action string, at timestamp",
    )
    rows = {r.id: r for r in lifecycle.recommendation_transitions(existing, actions).collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["completed", "dismissed", "dismissed", "open"]
    assert rows[3].resolved_at is None and rows[1].resolved_at is not None


def test_sustained_window_is_a_setting(fleet):
    two = replace(DEFAULTS, sustained_window=2)
    found = propose(fleet, [(1, minutes(1), 30.0), (1, minutes(3), 29.0)], settings=two)
    assert found["temperature_high"].reason == "Last 2 temperature readings from sensor #1 were all above 26C."


def test_affected_zones(fleet):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"), (3, 2, "co2"))
    readings = fleet.readings((1, DAY, 1.0), (2, DAY, 1.0), (99, DAY, 1.0))
    assert [r.zone_id for r in lifecycle.affected_zones(readings, sensors).collect()] == [1]
