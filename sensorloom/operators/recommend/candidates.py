"""Running rules over a context."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.overview import TARGETED_TYPES
from sensorloom.operators.recommend.context import Context
from sensorloom.operators.recommend.rules import RULES, FrameRule, ZoneRule
from sensorloom.schemas import CANDIDATE_RECOMMENDATIONS

logger = logging.getLogger(__name__)


def _with_limits(zones: DataFrame) -> DataFrame:
    """Targets as doubles under the short names the rules use."""
    limits = [
        f"CAST(target_{kind}_{bound} AS DOUBLE) AS {kind}_{name}"
        for kind in TARGETED_TYPES
        for bound, name in (("min", "low"), ("max", "high"))
    ]
    return zones.selectExpr("*", *limits)


def ready_rules(
    context: Context, rules: Sequence[ZoneRule | FrameRule] = RULES
) -> tuple[list[ZoneRule | FrameRule], set[str]]:
    """The rules that can be evaluated in a context, and the recommendation types they speak for.

    A rule that cannot be built is logged and left out, and so is the yield rule without a
    model. What they have proposed before is neither confirmed nor over: reconcile with the
    types returned here.
    """
    zones, ready = _with_limits(context.zones), []
    for rule in rules:
        if rule.name == "yield_risk" and "predicted_yield" not in context.zones.columns:
            continue
        try:
            if isinstance(rule, ZoneRule):
                zones.selectExpr(rule.candidate(context))
            else:
                rule.candidates(context)
            ready.append(rule)
        except Exception:
            logger.exception("rule %s failed", rule.name)
    return ready, {rule.name for rule in ready}


def all_candidates(context: Context, rules: Sequence[ZoneRule | FrameRule] = RULES) -> DataFrame:
    """Everything the rules that can be evaluated propose."""
    ready, _ = ready_rules(context, rules)
    zones = _with_limits(context.zones)
    structs = [rule.candidate(context) for rule in ready if isinstance(rule, ZoneRule)]
    frames = [rule.candidates(context) for rule in ready if isinstance(rule, FrameRule)]
    if structs:
        frames.insert(0, zones.selectExpr(f"inline(array_compact(array({', '.join(structs)})))"))
    if not frames:
        return context.zones.sparkSession.createDataFrame([], CANDIDATE_RECOMMENDATIONS)
    return reduce(DataFrame.unionByName, frames)


def recommendation_candidates(context: Context, rules: Sequence[ZoneRule | FrameRule] = RULES) -> DataFrame:
    """One candidate per site, zone and type; of several anomaly alerts the highest id speaks."""
    scope = Window.partitionBy(
        "greenhouse_id", F.coalesce("zone_id", F.lit(0)), "recommendation_type"
    ).orderBy(F.col("source_id").desc_nulls_last())
    return (
        all_candidates(context, rules)
        .withColumn("_rank", F.row_number().over(scope))
        .filter("_rank = 1")
        .drop("_rank")
    )
