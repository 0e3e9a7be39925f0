"""Joins of a large, possibly skewed fact with a dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(facts: DataFrame, dimension: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join facts with a dimension of unknown size.

    No hint and no salt: Catalyst broadcasts the dimension as it is while its size is under
    the session's threshold. Beyond it both sides are shuffled on the key, and AQE splits the
    partition of a hot key on the fact side.

    ``how`` is inner, left, left_semi or left_anti: kinds whose fact side can be split.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"a lookup cannot be a {how} join")
    return facts.join(dimension, [on] if isinstance(on, str) else list(on), how)
