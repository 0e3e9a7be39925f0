"""Classification of a measurement against its target range."""

from __future__ import annotations

from sensorloom.functions.numeric import nearest
from sensorloom.schemas import ENVIRONMENT_STATUSES
from sensorloom.settings import DEFAULTS


def _distance(value: str, low: str, high: str) -> str:
    return f"(CASE WHEN {value} < {low} THEN {low} - {value} ELSE {value} - {high} END)"


def status_of(value: str, low: str, high: str, tolerance_percent: float = DEFAULTS.warning_tolerance_percent) -> str:
    """normal inside the range, warning within the tolerance of the span, else critical.

    A missing value or range is unknown, and so is a value outside an empty range.
    """
    span = f"({high} - {low})"
    return (
        f"CASE WHEN {value} IS NULL OR {low} IS NULL OR {high} IS NULL THEN 'unknown' "
        f"WHEN {value} BETWEEN {low} AND {high} THEN 'normal' "
        f"WHEN {span} <= 0 THEN 'unknown' "
        f"WHEN {_distance(value, low, high)} <= {span} * {float(tolerance_percent)}D / 100D THEN 'warning' "
        f"ELSE 'critical' END"
    )


def deviation_percent(value: str, low: str, high: str) -> str:
    """Signed distance outside the range in percent of its span; negative is below."""
    span = f"({high} - {low})"
    signed = (
        f"(CASE WHEN {value} < {low} THEN -(({low} - {value}) / {span}) ELSE ({value} - {high}) / {span} END * 100D)"
    )
    return (
        f"CASE WHEN {value} IS NULL OR {low} IS NULL OR {high} IS NULL THEN CAST(NULL AS DOUBLE) "
        f"WHEN {value} BETWEEN {low} AND {high} THEN 0D "
        f"WHEN {span} <= 0 THEN CAST(NULL AS DOUBLE) "
        f"ELSE {nearest(signed, 2)} END"
    )


def worst_status(status: str) -> str:
    """Aggregate: the most severe status of a group, unknown when there is none."""
    names = ", ".join(f"'{name}'" for name in ENVIRONMENT_STATUSES)
    return f"element_at(array({names}), CAST(coalesce(max(array_position(array({names}), {status})), 1) AS INT))"
