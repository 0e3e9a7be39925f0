"""Regression metrics as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(scored: DataFrame, label: str, prediction: str, *groups: str) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (percent, over non-zero labels; NaN when there are none)."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    squared = F.avg(error * error)
    share = F.when(y != 0, F.abs(error / F.nullif(y, F.lit(0.0))))
    return scored.groupBy(*groups).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squared).alias("rmse"),
        (1.0 - squared / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.coalesce(F.avg(share) * 100.0, F.lit(float("nan"))).alias("mape"),
        F.count(F.lit(1)).alias("row_count"),
    )
