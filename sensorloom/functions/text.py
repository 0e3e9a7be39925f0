"""Text expressions for labels and messages."""

from __future__ import annotations

import re

from sensorloom.functions.numeric import nearest


def quoted(text: str) -> str:
    """A string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sentence(template: str, **parts: str) -> str:
    """Text with ``{name}`` places filled by expressions; null when any of them is."""
    pieces = re.split(r"\{(\w+)\}", template)
    texts = [quoted(p) if i % 2 == 0 else f"CAST({parts[p]} AS STRING)" for i, p in enumerate(pieces) if p]
    return f"concat({', '.join(texts)})"


def label(name: str) -> str:
    """soil_moisture becomes Soil Moisture."""
    return f"initcap(replace({name}, '_', ' '))"


def decimal_text(value: str) -> str:
    """A 4-decimal number as plain digits with one decimal at least: 18.0, 26.55."""
    return f"regexp_replace(CAST(CAST({value} AS DECIMAL(38,4)) AS STRING), '0{{1,3}}$', '')"


def fixed(value: str, digits: int) -> str:
    """Fixed number of decimals, rounded by binary value; null stays null."""
    return f"CASE WHEN ({value}) IS NOT NULL THEN format_string('%.{digits}f', {nearest(value, digits)}) END"


def compact(value: str, unit: str = "") -> str:
    """Two decimals at most, no trailing zeros, then the unit."""
    return f"concat(regexp_replace({fixed(value, 2)}, '[.]?0+$', ''), {quoted(unit)})"


def whole_minutes(newest: str, oldest: str) -> str:
    """Whole minutes between two timestamps, one at least."""
    return f"greatest(1L, CAST(floor((unix_micros({newest}) - unix_micros({oldest})) / 60000000D) AS BIGINT))"
