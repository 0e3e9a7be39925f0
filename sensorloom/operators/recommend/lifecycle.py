"""Reconciling candidates with open recommendations."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.time import Instant, instant
from sensorloom.operators.alerts import first_actions
from sensorloom.operators.joins import lookup_join
from sensorloom.schemas import RECOMMENDATIONS


def recommendation_reconcile(
    recommendations: DataFrame,
    candidates: DataFrame,
    evaluated_zones: DataFrame,
    as_of: Instant,
    scope: str = "greenhouse",
    types: Collection[str] | None = None,
) -> DataFrame:
    """Meet open recommendations with the candidates of the evaluated zones.

    update: still proposed. insert: newly proposed. complete: open in the evaluated
    scope and no longer proposed. keep: outside that scope. With ``greenhouse`` the
    scope is every zone of an evaluated zone's site, so evaluating one zone closes its
    neighbours' items too; ``zones`` limits it to the zones themselves. ``types`` names the
    recommendation types whose rules were evaluated: others are kept, not completed.
    """
    if scope not in {"greenhouse", "zones"}:
        raise ValueError("scope must be greenhouse or zones")
    now = instant(as_of)
    zone_key = F.coalesce("zone_id", F.lit(0)).alias("zone_key")
    reach = ["greenhouse_id"] if scope == "greenhouse" else ["greenhouse_id", "zone_key"]
    evaluated = (
        evaluated_zones.select("greenhouse_id", zone_key).select(*reach).distinct().withColumn("evaluated", F.lit(True))
    )
    opened = recommendations.filter("status = 'open'").withColumn("zone_key", zone_key)
    opened = lookup_join(opened, evaluated, reach, "left")
    keys = ["greenhouse_id", "zone_key", "recommendation_type"]
    proposed = candidates.withColumns({"zone_key": zone_key, "proposed": F.lit(True)})
    joined = opened.alias("r").join(proposed.alias("c"), keys, "full_outer")
    exists, is_proposed = F.col("r.id").isNotNull(), F.col("c.proposed").isNotNull()
    spoken_for = F.lit(True) if types is None else F.col("recommendation_type").isin(*types)
    action = (
        F.when(exists & is_proposed, "update")
        .when(is_proposed, "insert")
        .when(F.col("r.evaluated").isNotNull() & spoken_for, "complete")
        .otherwise("keep")
    )
    is_new, completes = F.col("action") == "insert", F.col("action") == "complete"
    changed = is_proposed | completes

    def evolving(name: str) -> Column:
        return F.when(is_proposed, F.col(f"c.{name}")).otherwise(F.col(f"r.{name}")).alias(name)

    return joined.withColumn("action", action).select(
        F.when(is_new, F.xxhash64(*keys, now)).otherwise(F.col("r.id")).alias("id"),
        "greenhouse_id",
        F.when(is_new, F.col("c.zone_id")).otherwise(F.col("r.zone_id")).alias("zone_id"),
        evolving("sensor_id"),
        "recommendation_type",
        evolving("priority"),
        F.when(completes, "completed").otherwise("open").alias("status"),
        evolving("message"),
        evolving("reason"),
        F.coalesce("r.created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("r.updated_at")).alias("updated_at"),
        F.when(completes, now).otherwise(F.col("r.resolved_at")).alias("resolved_at"),
        "action",
    )


def reconcile_stats(reconciled: DataFrame) -> DataFrame:
    """produced, created, updated and closed counts of one evaluation."""

    def count(*actions: str) -> Column:
        return F.count_if(F.col("action").isin(*actions))

    return reconciled.agg(
        count("insert", "update").alias("produced"),
        count("insert").alias("created"),
        count("update").alias("updated"),
        count("complete").alias("closed"),
    )


def apply_recommendation_changes(recommendations: DataFrame, reconciled: DataFrame) -> DataFrame:
    """The next full snapshot: closed items as they were, open ones as reconciled."""
    names = RECOMMENDATIONS.fieldNames()
    closed = recommendations.filter("status <> 'open'")
    return closed.select(*names).unionByName(reconciled.select(*names))


def recommendation_transitions(recommendations: DataFrame, actions: DataFrame) -> DataFrame:
    """Dismiss or complete open items; the earlier request wins, others change nothing."""
    wanted = first_actions(actions).select("id", "dismiss_at", "complete_at")
    opened = F.col("status") == "open"
    dismissed = F.col("dismiss_at").isNotNull() & (
        F.col("complete_at").isNull() | (F.col("dismiss_at") <= F.col("complete_at"))
    )
    completed = F.col("complete_at").isNotNull() & ~dismissed
    at = F.least("dismiss_at", "complete_at")
    return recommendations.join(wanted, "id", "left").select(
        *[c for c in recommendations.columns if c not in {"status", "updated_at", "resolved_at"}],
        F.when(opened & dismissed, "dismissed")
        .when(opened & completed, "completed")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(opened & at.isNotNull(), at).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(opened & at.isNotNull(), at).otherwise(F.col("resolved_at")).alias("resolved_at"),
    )


def affected_zones(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Zones that have a sensor among the readings; sensors are made distinct before the join."""
    touched = readings.select(F.col("sensor_id").alias("id")).distinct()
    return sensors.join(touched, "id", "left_semi").select("zone_id").distinct()
