"""The seven rules.

A zone rule is one struct expression over the wide zone row, null where it does not fire;
all zone rules are evaluated in a single projection. A frame rule builds its own candidate
frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.text import compact, fixed, sentence, whole_minutes
from sensorloom.operators.recommend.context import Context
from sensorloom.schemas import CANDIDATE_RECOMMENDATIONS


# The sentences, types and priorities in this module are output and must match.


@dataclass(frozen=True)
class ZoneRule:
    name: str
    candidate: Callable[[Context], str]


@dataclass(frozen=True)
class FrameRule:
    name: str
    candidates: Callable[[Context], DataFrame]


def _candidate(when: str, kind: str, priority: str, sensor: str, message: str, reason: str) -> str:
    values = [f"'{kind}'", priority, "greenhouse_id", "zone_id", sensor, message, reason, "NULL"]
    fields = ", ".join(
        f"'{field.name}', CAST({value} AS {field.dataType.simpleString()})"
        for field, value in zip(CANDIDATE_RECOMMENDATIONS.fields, values, strict=True)
    )
    return f"CASE WHEN {when} THEN named_struct({fields}) END"


def irrigation_needed(context: Context) -> str:
    value, low, high = "soil_moisture_value", "soil_moisture_low", "soil_moisture_high"
    texts = {
        "zone": "name",
        "sensor": "soil_moisture_sensor_id",
        "value": compact(value, "%"),
        "low": compact(low, "%"),
        "high": compact(high, "%"),
    }
    return _candidate(
        f"{value} < {low} AND {high} IS NOT NULL",
        "irrigation_needed",
        f"if({low} - {value} >= ({high} - {low}) * 0.5D, 'critical', 'high')",
        "soil_moisture_sensor_id",
        sentence(
            "Soil moisture in {zone} is {value}, below the target minimum of {low}. Irrigation is recommended.", **texts
        ),
        sentence(
            "Zone target for soil moisture is {low}-{high}. Latest reading from sensor #{sensor} (Soil Moisture) is {value}.",
            **texts,
        ),
    )


def sustained_temperature(context: Context, above: bool) -> str:
    """The newest N readings all beyond the target; fewer than N never fire."""
    needed = context.settings.sustained_window
    low, high = "temperature_low", "temperature_high"
    beyond = f"temperature_window_min > {high}" if above else f"temperature_window_max < {low}"
    word, action = ("above", "Increase ventilation") if above else ("below", "Activate heating")
    texts = {
        "zone": "name",
        "sensor": "temperature_sensor_id",
        "minutes": whole_minutes("temperature_at", "temperature_window_start"),
        "mean": compact("temperature_window_avg", "C"),
        "low": compact(low, "C"),
        "high": compact(high, "C"),
        "limit": compact(high if above else low, "C"),
    }
    return _candidate(
        f"temperature_window_count >= {needed} AND {low} IS NOT NULL AND {high} IS NOT NULL AND {beyond}",
        "temperature_high" if above else "temperature_low",
        "'high'",
        "temperature_sensor_id",
        sentence(
            f"{{zone}} temperature has been {word} the crop target for the last ~{{minutes}} minutes "
            f"(avg {{mean}} vs target {{low}}-{{high}}). {action}.",
            **texts,
        ),
        sentence(f"Last {needed} temperature readings from sensor #{{sensor}} were all {word} {{limit}}.", **texts),
    )


def humidity_high_risk(context: Context) -> str:
    value, low, high = "humidity_value", "humidity_low", "humidity_high"
    texts = {
        "zone": "name",
        "sensor": "humidity_sensor_id",
        "value": compact(value, "%"),
        "low": compact(low, "%"),
        "high": compact(high, "%"),
    }
    return _candidate(
        f"{value} > {high} AND {low} IS NOT NULL",
        "humidity_high_risk",
        f"if({value} - {high} >= 10D, 'high', 'medium')",
        "humidity_sensor_id",
        sentence(
            "Humidity in {zone} is {value}, above the target maximum of {high}. "
            "Sustained high humidity increases fungal disease risk.",
            **texts,
        ),
        sentence(
            "Zone humidity target is {low}-{high}. Latest reading from sensor #{sensor} is {value}.", **texts
        ),
    )


def co2_out_of_range(context: Context) -> str:
    low, high = context.settings.co2_min_ppm, context.settings.co2_max_ppm
    span = f"{int(low)}-{int(high)} ppm"
    texts = {
        "zone": "name",
        "sensor": "co2_sensor_id",
        "value": compact("co2_value", " ppm"),
        "side": f"if(co2_value > {float(high)}D, 'above', 'below')",
    }
    return _candidate(
        f"co2_value NOT BETWEEN {float(low)}D AND {float(high)}D",
        "co2_out_of_range",
        "'medium'",
        "co2_sensor_id",
        sentence(f"CO2 in {{zone}} is {{value}}, {{side}} the acceptable range ({span}).", **texts),
        sentence(
            f"Latest CO2 reading from sensor #{{sensor}} is {{value}} against configured bounds {span}.", **texts
        ),
    )


def yield_risk(context: Context) -> str:
    """Predicted yield well below the crop's baseline; needs a prediction and a known crop."""
    baselines = {crop: base for crop, base in context.settings.yield_baselines.items() if base > 0}
    cases = " ".join(f"WHEN '{crop}' THEN {float(base)}D" for crop, base in baselines.items())
    baseline = f"(CASE lower(crop_type) {cases} END)"
    texts = {
        "zone": "name",
        "crop": "crop_type",
        "predicted": compact("predicted_yield", " kg/m2"),
        "baseline": compact(baseline, " kg/m2"),
        "shortfall": fixed(f"({baseline} - predicted_yield) / {baseline} * 100D", 1),
    }
    return _candidate(
        f"predicted_yield < {baseline} * {float(context.settings.yield_risk_ratio)}D",
        "yield_risk",
        "'high'",
        "NULL",
        sentence(
            "Current environmental trends in {zone} may reduce predicted yield to {predicted} (baseline {baseline}).",
            **texts,
        ),
        sentence(
            f"ML model {context.model_version} predicts yield {{shortfall}}% below the {{crop}} baseline "
            "under the zone's current averaged conditions.",
            **texts,
        ),
    )


def anomaly_review(context: Context) -> DataFrame:
    """One candidate per active anomaly alert; a missing or zero zone has no name."""
    names = context.zones.select("zone_id", F.col("name").alias("zone_name"))
    alerts = context.open_alerts.filter("alert_type = 'anomaly'").join(names, "zone_id", "left")
    zone = "if(zone_id <> 0 AND zone_name IS NOT NULL, zone_name, concat('zone #', coalesce(CAST(zone_id AS STRING), 'None')))"
    message = sentence(
        "Statistical anomaly detected in {zone}. Review recent readings and confirm sensor integrity.", zone=zone
    )
    reason = sentence("Open anomaly alert #{id}: {message}", id="id", message="message")
    return alerts.selectExpr(
        "'anomaly_review' AS recommendation_type",
        "if(severity = 'critical', 'high', 'medium') AS priority",
        "greenhouse_id",
        "zone_id",
        "sensor_id",
        f"{message} AS message",
        f"{reason} AS reason",
        "CAST(id AS BIGINT) AS source_id",
    )


RULES: tuple[ZoneRule | FrameRule, ...] = (
    ZoneRule("irrigation_needed", irrigation_needed),
    ZoneRule("temperature_high", partial(sustained_temperature, above=True)),
    ZoneRule("temperature_low", partial(sustained_temperature, above=False)),
    ZoneRule("humidity_high_risk", humidity_high_risk),
    ZoneRule("co2_out_of_range", co2_out_of_range),
    FrameRule("anomaly_review", anomaly_review),
    ZoneRule("yield_risk", yield_risk),
)
