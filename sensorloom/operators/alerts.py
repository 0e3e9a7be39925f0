"""Alert evaluation and the open / acknowledged / resolved lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.numeric import nearest
from sensorloom.functions.status import status_of
from sensorloom.functions.text import decimal_text, fixed, label, sentence
from sensorloom.functions.time import Instant, instant
from sensorloom.operators.anomaly import anomaly_latest
from sensorloom.operators.history import latest_per_sensor
from sensorloom.operators.overview import placed_sensors, resolved_ranges
from sensorloom.schemas import ACTIVE_ALERT_STATUSES, ALERTS
from sensorloom.settings import DEFAULTS, Settings

# The sentences of alerts in this module are output and must match.
# One row per evaluated (sensor, alert type); ``fired`` says whether its condition holds.
EVALUATION = (
    "sensor_id", "alert_type", "fired", "greenhouse_id", "zone_id", "severity", "message", "value", "threshold",
)


def threshold_evaluation(
    sensors: DataFrame, zones: DataFrame, readings: DataFrame, as_of: Instant, settings: Settings = DEFAULTS
) -> DataFrame:
    """Both threshold types of every sensor that has a reading and a range.

    Readings of more than a day after ``as_of`` come from a wrong clock and are not looked at:
    as the newest ones they would keep an alert firing whatever arrives.
    """
    readings = readings.filter(F.col("timestamp") <= instant(as_of) + F.make_dt_interval(days=F.lit(1)))
    status = status_of("value", "range_min", "range_max", settings.warning_tolerance_percent)
    ranged = resolved_ranges(sensors, zones, settings).filter("range_min IS NOT NULL AND range_max IS NOT NULL")
    latest = ranged.join(latest_per_sensor(readings), "sensor_id").withColumn("status", F.expr(status))
    outside = "status IN ('warning', 'critical')"

    def side(alert_type: str, beyond: str, word: str, limit: str) -> str:
        fires = f"({outside} AND {beyond})"
        text = sentence(
            f"{{kind}} {{value}}{{unit}} is {word} target {{limit}}{{unit}}",
            kind=label("sensor_type"), value=decimal_text("value"), unit="unit", limit=decimal_text(limit),
        )
        return (
            f"named_struct('alert_type', '{alert_type}', 'fired', {fires}, "
            f"'severity', if({fires}, status, NULL), 'message', if({fires}, {text}, NULL))"
        )

    above = side("threshold_high", "value > range_max", "above", "range_max")
    below = side("threshold_low", "NOT value > range_max", "below", "range_min")
    threshold = sentence(
        "{low}–{high} {unit}", low=decimal_text("range_min"), high=decimal_text("range_max"), unit="unit"
    )
    return latest.selectExpr(
        "sensor_id", "greenhouse_id", "zone_id", "value", f"{threshold} AS threshold", f"inline(array({above}, {below}))"
    ).select(*EVALUATION)


def anomaly_evaluation(
    sensors: DataFrame, zones: DataFrame, readings: DataFrame, as_of: Instant, settings: Settings = DEFAULTS,
    detector=None,
) -> DataFrame:
    """The anomaly type of every sensor with a recent reading."""
    verdicts = anomaly_latest(readings, as_of, settings, detector)
    text = sentence(
        "{kind} {value}{unit} is a statistical anomaly (z={z})",
        kind=label("sensor_type"), value=decimal_text("current_value"), unit="unit", z=fixed("z_score", 2),
    )
    return verdicts.join(placed_sensors(sensors, zones), "sensor_id").selectExpr(
        "sensor_id",
        "'anomaly' AS alert_type",
        "is_anomaly AS fired",
        "greenhouse_id",
        "zone_id",
        "if(is_anomaly, 'warning', NULL) AS severity",
        f"if(is_anomaly, {text}, NULL) AS message",
        "coalesce(current_value, 0D) AS value",
        f"'z>{float(settings.anomaly_z)}' AS threshold",
    )


def fired(evaluation: DataFrame) -> DataFrame:
    """The candidate alerts of an evaluation."""
    return evaluation.filter("fired").drop("fired")


def alert_evaluation(
    sensors: DataFrame, zones: DataFrame, readings: DataFrame, as_of: Instant, settings: Settings = DEFAULTS,
    detector=None,
) -> DataFrame:
    return threshold_evaluation(sensors, zones, readings, as_of, settings).unionByName(
        anomaly_evaluation(sensors, zones, readings, as_of, settings, detector)
    )


def alert_reconcile(alerts: DataFrame, evaluation: DataFrame, as_of: Instant) -> DataFrame:
    """Meet active alerts with what was evaluated; one row per alert that stays or changes.

    update: still firing, keeps its status and creation time. insert: newly firing.
    resolve: evaluated and no longer firing. keep: not evaluated. Both sides hold at
    most one row per (sensor, type), so the join key cannot be skewed.
    """
    keys = ["sensor_id", "alert_type"]
    now = instant(as_of)
    active = alerts.filter(F.col("status").isin(*ACTIVE_ALERT_STATUSES)).alias("a")
    found = evaluation.withColumn("evaluated", F.lit(True)).alias("e")
    joined = active.join(found, keys, "full_outer")
    exists = F.col("a.id").isNotNull()
    fires = F.coalesce(F.col("e.fired"), F.lit(False))
    seen = F.coalesce(F.col("e.evaluated"), F.lit(False))
    action = (
        F.when(exists & fires, "update")
        .when(fires, "insert")
        .when(exists & seen, "resolve")
        .when(exists, "keep")
    )
    new_id = F.xxhash64(F.col("sensor_id"), F.col("alert_type"), now)
    is_new, resolves = F.col("action") == "insert", F.col("action") == "resolve"

    def evolving(name: str, value: Column | None = None) -> Column:
        return F.when(fires, F.col(f"e.{name}") if value is None else value).otherwise(F.col(f"a.{name}")).alias(name)

    value = F.expr(f"CAST({nearest('e.value', 4)} AS DECIMAL(12,4))")
    return joined.withColumn("action", action).filter(F.col("action").isNotNull()).select(
        F.when(is_new, new_id).otherwise(F.col("a.id")).alias("id"),
        F.coalesce("a.greenhouse_id", "e.greenhouse_id").alias("greenhouse_id"),
        F.coalesce("a.zone_id", "e.zone_id").alias("zone_id"),
        "sensor_id",
        "alert_type",
        evolving("severity"),
        F.when(is_new, "open").when(resolves, "resolved").otherwise(F.col("a.status")).alias("status"),
        evolving("message"),
        evolving("value", value),
        evolving("threshold"),
        F.coalesce("a.created_at", now).alias("created_at"),
        "a.acknowledged_at",
        F.when(resolves, now).otherwise(F.col("a.resolved_at")).alias("resolved_at"),
        "action",
    )


def apply_alert_changes(alerts: DataFrame, reconciled: DataFrame) -> DataFrame:
    """The next full snapshot: closed alerts as they were, active ones as reconciled."""
    closed = alerts.filter(~F.col("status").isin(*ACTIVE_ALERT_STATUSES))
    names = ALERTS.fieldNames()
    return closed.select(*names).unionByName(reconciled.select(*names))


def first_actions(actions: DataFrame) -> DataFrame:
    """Requested transitions (id, action, at), folded to the first time per id and action."""

    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, F.col("at"))).alias(f"{action}_at")

    return actions.groupBy("id").agg(*[first(a) for a in ("acknowledge", "resolve", "dismiss", "complete")])


def alert_transitions(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Acknowledge open alerts and resolve any that are not resolved; repeats change nothing."""
    wanted = first_actions(actions).select("id", "acknowledge_at", "resolve_at")
    resolve = F.col("resolve_at").isNotNull() & (F.col("status") != "resolved")
    in_time = F.col("resolve_at").isNull() | (F.col("acknowledge_at") <= F.col("resolve_at"))
    acknowledge = F.col("acknowledge_at").isNotNull() & (F.col("status") == "open") & in_time
    return alerts.join(wanted, "id", "left").select(
        *[c for c in alerts.columns if c not in {"status", "acknowledged_at", "resolved_at"}],
        F.when(resolve, "resolved").when(acknowledge, "acknowledged").otherwise(F.col("status")).alias("status"),
        F.when(acknowledge, F.col("acknowledge_at")).otherwise(F.col("acknowledged_at")).alias("acknowledged_at"),
        F.when(resolve, F.col("resolve_at")).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def unknown_ids(entities: DataFrame, actions: DataFrame) -> DataFrame:
    """Requested ids that no entity has."""
    return actions.select("id").distinct().join(entities.select("id"), "id", "left_anti")
