from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.sources.snapshots import SnapshotStore
from sensorloom.streaming import lifecycle
from tests.conftest import NOON, minutes

SCHEMA = "id long, status string"


def store(spark, path, fan=2):
    schema = spark.createDataFrame([], SCHEMA).schema
    return SnapshotStore(spark, str(path / "store"), schema, ("open",), fan)


def contents(frame):
    return sorted((r.id, r.status) for r in frame.collect())


def test_folders_stay_bounded_and_nothing_is_lost(spark, tmp_path):
    kept = store(spark, tmp_path)
    for batch in range(19):  # each version closes the row before and opens one
        with kept.turn(lambda: NOON, batch) as turn:
            assert turn.version == batch
            closing = kept.before(turn).withColumn("status", F.lit("closed"))
            kept.write(turn, closing.unionByName(spark.createDataFrame([(batch, "open")], SCHEMA)))
        assert contents(kept.rows()) == [(i, "closed") for i in range(batch)] + [(batch, "open")]
    for version in (16, 17):
        assert contents(kept.rows(version)) == [(i, "closed") for i in range(version)] + [(version, "open")]
    with pytest.raises(ValueError):
        kept.rows(3)
    folders = {p.name: len(list(p.iterdir())) for p in (tmp_path / "store").iterdir()}
    assert all(count <= 4 for count in folders.values())
    assert {n for n in folders if n.startswith("closed")} == {f"closed_{level}" for level in range(5)}


def test_a_write_that_was_cut_off_is_made_again(spark, tmp_path, monkeypatch):
    kept = store(spark, tmp_path)
    clock = iter([NOON + timedelta(hours=i) for i in range(99)])
    for batch in range(9):
        def evaluate():
            with kept.turn(lambda: next(clock), batch) as turn:
                closing = kept.before(turn).withColumn("status", F.lit("closed"))
                kept.write(turn, closing.unionByName(spark.createDataFrame([(batch, "open")], SCHEMA)))
                return turn

        failed = []
        with monkeypatch.context() as patch:
            def cut(self, path, **values):
                if "commits" in path:
                    failed.append(path)
                    raise OSError("lost")
                return whole(self, path, **values)

            whole = SnapshotStore._write_one
            patch.setattr(SnapshotStore, "_write_one", cut)
            with pytest.raises(OSError):
                evaluate()
        assert failed and kept.latest_version() == (batch - 1 if batch else None)
        assert contents(kept.rows()) == [(i, "closed") for i in range(batch - 1)] + ([(batch - 1, "open")] if batch else [])
        # the clock of the batch is the one it first had
        assert evaluate().at == NOON + timedelta(hours=batch)
        assert contents(kept.rows()) == [(i, "closed") for i in range(batch)] + [(batch, "open")]
    with kept.turn(lambda: NOON, 8) as turn:
        assert turn is None


def test_actions_are_kept_by_later_batches(spark, fleet, tmp_path):
    sensors, zones = fleet.sensors((1, 1, "temperature"), (2, 2, "soil_moisture")), fleet.zones(1, 2)
    schema = "sensor_id int, timestamp timestamp, value double"
    seen = []

    def evaluate(batch, *rows):
        seen.extend(rows)
        stored = spark.createDataFrame(seen, schema)
        now = NOON + timedelta(seconds=batch)
        table = lifecycle.Fleet(lambda: sensors, lambda: zones, lambda: stored, lambda: now)
        arrived = spark.createDataFrame(list(rows), schema)
        lifecycle.evaluate_alerts(arrived, batch, table, alerts)
        lifecycle.evaluate_recommendations(arrived, batch, table, recs, alerts.current)

    def actions(*rows):
        return spark.createDataFrame([(*r, NOON) for r in rows], "id long, action string, at timestamp")

    alerts = SnapshotStore(spark, str(tmp_path / "alerts"), schemas.ALERTS, schemas.ACTIVE_ALERT_STATUSES)
    recs = SnapshotStore(spark, str(tmp_path / "recs"), schemas.RECOMMENDATIONS, ("open",))
    evaluate(0, (1, minutes(9), 40.0), (2, minutes(9), 30.0))
    hot, dry = (r.id for r in alerts.rows().orderBy("sensor_id").collect())
    water = recs.rows().collect()[0].id
    assert lifecycle.store_alert_actions(alerts, actions((hot, "acknowledge"), (12345, "resolve"))) == [12345]
    assert lifecycle.store_alert_actions(alerts, actions((dry, "resolve"))) == []
    assert lifecycle.store_recommendation_actions(recs, actions((water, "dismiss"))) == []

    def statuses(kept):
        return {r.id: r.status for r in kept.rows().collect()}

    assert statuses(alerts) == {hot: "acknowledged", dry: "resolved"} and statuses(recs) == {water: "dismissed"}
    evaluate(0, (1, minutes(9), 40.0))  # the batch again: it was stored, so nothing changes
    assert statuses(alerts) == {hot: "acknowledged", dry: "resolved"} and alerts.latest_version() == 2
    evaluate(1, (1, minutes(8), 41.0))
    row = alerts.rows().filter(F.col("id") == hot).first()
    assert (row.status, float(row.value), row.acknowledged_at is not None) == ("acknowledged", 41.0, True)
    # still dry: what a person closed stays closed, and a new item opens
    evaluate(2, (2, minutes(7), 29.0))
    assert sorted(statuses(alerts).values()) == ["acknowledged", "open", "resolved"]
    assert sorted(statuses(recs).values()) == ["dismissed", "open"]
    # an action on a closed row changes nothing and is not unknown
    assert lifecycle.store_alert_actions(alerts, actions((dry, "acknowledge"))) == []
    assert statuses(alerts)[dry] == "resolved"
