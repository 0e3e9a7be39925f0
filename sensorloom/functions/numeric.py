"""Rounding and averaging expressions with exactly reproducible results."""

from __future__ import annotations

_SPLITTER = "134217729D"  # 2**27 + 1: halves a double's mantissa without loss


def nearest(x: str, digits: int) -> str:
    """Round a double to ``digits`` places by its binary value, ties to even.

    Built-in rounding works on the shortest decimal text of a double, where 2.675 is a
    tie; its stored value is just below, so the result here is 2.67. The scaled value may
    only look like a tie, hence the exact error of the product decides.
    """
    scale = f"{10**digits}D"
    scaled = f"(({x}) * {scale})"
    high = f"(({x}) * {_SPLITTER} - (({x}) * {_SPLITTER} - ({x})))"
    error = f"({high} * {scale} - {scaled} + (({x}) - {high}) * {scale})"
    below = f"CAST(floor({scaled}) AS DOUBLE)"
    part = f"({scaled} - {below})"
    return (
        f"(CASE WHEN {part} > 0.5D OR ({part} = 0.5D AND {error} > 0) THEN {below} + 1 "
        f"WHEN {part} < 0.5D OR {error} < 0 THEN {below} "
        f"ELSE {below} + pmod({below}, 2D) END / {scale})"
    )


def exact_mean(value: str) -> str:
    """Average of 4-decimal measurements, the same for any partitioning.

    Floating sums depend on the order partial results are merged in; a retried task could
    then publish another number. A decimal sum cannot.
    """
    return f"CAST(sum(CAST({value} AS DECIMAL(12,4))) AS DOUBLE) / nullif(count({value}), 0)"


def or_default(value: str, default: float) -> str:
    """``value``, or the default where it is null or zero."""
    return f"coalesce(nullif({value}, 0D), {default}D)"


def at_least_zero(value: str) -> str:
    return f"greatest(0D, {value})"


def percent_of(part: str, whole: str) -> str:
    """part / whole * 100 in decimals, two places, half up; null when whole is 0."""
    return f"round(CAST({part} AS DECIMAL(20,0)) / nullif({whole}, 0) * 100, 2)"
