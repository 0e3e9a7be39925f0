"""Alerts and recommendations kept up to date as readings arrive.

Two independent queries follow the stored readings with their own checkpoints: either may
fail without holding up ingestion or the other one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.functions.time import Instant, hours_before
from sensorloom.operators import alerts as alert_ops
from sensorloom.operators.joins import lookup_join
from sensorloom.operators.recommend import lifecycle
from sensorloom.operators.recommend.candidates import ready_rules, recommendation_candidates
from sensorloom.operators.recommend.context import build_context
from sensorloom.settings import DEFAULTS, Settings
from sensorloom.sources.snapshots import SnapshotStore

# Maps the wide zone rows to predicted yields (zone_id, predicted_yield).
Predictor = Callable[[DataFrame], DataFrame]


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass(frozen=True)
class Fleet:
    """What an evaluation reads: dimensions and the stored readings, loaded per batch."""

    sensors: Callable[[], DataFrame]
    zones: Callable[[], DataFrame]
    readings: Callable[[], DataFrame]
    clock: Callable[[], Instant] = _utc_now
    settings: Settings = DEFAULTS
    detector: Callable | None = None


def _since(readings: DataFrame, earliest: Column) -> DataFrame:
    """Readings not older than an instant; prunes the dates of a partitioned table."""
    recent = readings.filter(F.col("timestamp") >= earliest)
    return recent.filter(F.col("reading_date") >= F.to_date(earliest)) if "reading_date" in readings.columns else recent


def evaluate_alerts(arrived: DataFrame, batch_id: int, fleet: Fleet, store: SnapshotStore) -> None:
    """Re-evaluate the sensors of one micro-batch and store the next version.

    Every such sensor has a reading in the batch, so its newest stored one is no older than
    its newest in the batch: readings before the least of these and before the anomaly cutoff
    are not read. A late reading widens that only if its sensor sent nothing newer. A batch that
    was stored before changes nothing, so actions stored since are kept.
    """
    with store.turn(fleet.clock, batch_id) as turn:
        if turn is None:
            return
        touched = arrived.groupBy("sensor_id").agg(F.max("timestamp").alias("newest"))
        oldest = touched.agg(F.min("newest")).scalar()
        touched = touched.select("sensor_id")
        sensors = fleet.sensors().join(touched.withColumnRenamed("sensor_id", "id"), "id", "left_semi")
        earliest = F.least(oldest, hours_before(turn.at, fleet.settings.anomaly_max_age_hours))
        readings = lookup_join(_since(fleet.readings(), earliest), touched, "sensor_id", "left_semi")
        evaluation = alert_ops.alert_evaluation(
            sensors, fleet.zones(), readings, turn.at, fleet.settings, fleet.detector
        )
        store.write(turn, alert_ops.alert_reconcile(store.before(turn), evaluation, turn.at))


def evaluate_recommendations(
    arrived: DataFrame,
    batch_id: int,
    fleet: Fleet,
    store: SnapshotStore,
    alerts: Callable[[], DataFrame],
    predict: Predictor | None = None,
    model_version: str = "unknown",
    scope: str = "greenhouse",
) -> None:
    """Re-evaluate the zones of one micro-batch and store the next version.

    A batch that was stored before changes nothing.
    """
    with store.turn(fleet.clock, batch_id) as turn:
        if turn is None:
            return
        sensors = fleet.sensors()
        touched = lifecycle.affected_zones(arrived, sensors)
        zones = fleet.zones().join(touched.withColumnRenamed("zone_id", "id"), "id", "left_semi")
        sensors = sensors.join(touched, "zone_id", "left_semi")
        recent = _since(fleet.readings(), hours_before(turn.at, fleet.settings.recent_hours))
        readings = lookup_join(recent, sensors.select(F.col("id").alias("sensor_id")), "sensor_id", "left_semi")
        context = build_context(
            zones, sensors, readings, alerts(), turn.at, predict, model_version, fleet.settings
        )
        zones = context.zones.persist()  # read by the rules and for what was evaluated
        try:
            changes = lifecycle.recommendation_reconcile(
                store.before(turn), recommendation_candidates(context), zones, turn.at, scope, ready_rules(context)[1]
            )
            store.write(turn, changes)
        finally:
            zones.unpersist()


def store_alert_actions(store: SnapshotStore, actions: DataFrame, clock: Callable[[], Instant] = _utc_now) -> list[int]:
    """Store acknowledgements and resolutions of alerts; returns the unknown ids."""
    return store.store_actions(actions, alert_ops.alert_transitions, clock)


def store_recommendation_actions(
    store: SnapshotStore, actions: DataFrame, clock: Callable[[], Instant] = _utc_now
) -> list[int]:
    """Store dismissals and completions of recommendations; returns the unknown ids."""
    return store.store_actions(actions, lifecycle.recommendation_transitions, clock)


def start_evaluation(
    name: str, stored: DataFrame, checkpoint: str, evaluate: Callable[[DataFrame, int], None], **trigger
) -> StreamingQuery:
    """Follow the stored readings with one of the evaluations."""
    return (
        stored.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(evaluate)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
