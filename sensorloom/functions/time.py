"""Time arguments: every operator takes its clock as a parameter."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = Column | datetime | str


def instant(value: Instant) -> Column:
    """A timestamp column from a datetime, ISO text or a column; naive means UTC."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, datetime):
        if value.tzinfo is None:
            return F.lit(value.isoformat() + "Z").cast("timestamp")
        return F.lit(value.isoformat()).cast("timestamp")
    return F.lit(value).cast("timestamp")


def hours_before(value: Instant, hours: int) -> Column:
    return instant(value) - F.make_dt_interval(hours=F.lit(hours))


def minutes_before(value: Instant, minutes: int) -> Column:
    return instant(value) - F.make_dt_interval(mins=F.lit(minutes))


def latest_timestamp(readings: DataFrame) -> Column:
    """The newest reading's time as a scalar subquery, for use as ``as_of``."""
    return readings.agg(F.max("timestamp")).scalar()


def between(column: Column, start: Instant | None, end: Instant | None) -> Column:
    """Closed range; a missing end is open. A start after the end is an error."""
    check_order(start, end)
    condition = F.lit(True)
    if isinstance(start, Column) or isinstance(end, Column):
        if start is not None and end is not None:
            ordered = F.coalesce(instant(start) <= instant(end), F.lit(True))
            condition = F.assert_true(ordered, F.lit("start must not be after end")).isNull()
    if start is not None:
        condition = condition & (column >= instant(start))
    if end is not None:
        condition = condition & (column <= instant(end))
    return condition


def check_order(start: Instant | None, end: Instant | None) -> None:
    """Reject a window whose start lies after its end, given as datetimes or ISO texts."""
    first, last = _literal(start), _literal(end)
    if first is not None and last is not None and first > last:
        raise ValueError("start must not be after end")


def _literal(value: Instant | None) -> datetime | None:
    """The instant of a datetime or text; None for columns, which are checked as they run."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        return None
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
