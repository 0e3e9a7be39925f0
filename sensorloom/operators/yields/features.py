"""Feature columns and the preprocessing pipeline."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.text import quoted
from sensorloom.operators.selection import medians

TARGET = "yield_kg_per_m2"
CATEGORICAL = "crop_type"
# Names of the numeric inputs, as records and requests have them.
NUMERIC = (
    "avg_temperature_C",
    "min_temperature_C",
    "max_temperature_C",
    "humidity_percent",
    "co2_ppm",
    "light_intensity_lux",
    "photoperiod_hours",
    "irrigation_mm",
    "fertilizer_N_kg_ha",
    "fertilizer_P_kg_ha",
    "fertilizer_K_kg_ha",
    "pest_severity",
    "soil_pH",
    "days_to_maturity",
)
# Derived features; 23 C is the temperature without stress.
DERIVED = {
    "temp_range_C": "max_temperature_C - min_temperature_C",
    "temp_deviation_C": "abs(avg_temperature_C - 23.0D)",
    "light_daily_integral": "light_intensity_lux * photoperiod_hours",
    "nutrient_total_kg_ha": "fertilizer_N_kg_ha + fertilizer_P_kg_ha + fertilizer_K_kg_ha",
}
FEATURES = (*NUMERIC, *DERIVED)


def add_derived(records: DataFrame) -> DataFrame:
    return records.withColumns({name: F.expr(text) for name, text in DERIVED.items()})


def crop_counts(records: DataFrame) -> dict[str, int]:
    """Rows of each crop, crops ascending: one row per crop comes to the driver."""
    counts = records.filter(F.col(CATEGORICAL).isNotNull()).groupBy(CATEGORICAL).count().collect()
    return dict(sorted((row[0], row[1]) for row in counts))


def most_frequent_crop(records: DataFrame) -> str:
    """The mode of the crop column, ties by name."""
    return _mode(crop_counts(records))


def _mode(counts: dict[str, int]) -> str:
    return max(counts, key=counts.get, default="")  # the first of the greatest


def fitted_values(training: DataFrame) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Exact medians of the numeric features, then mean and population deviation of the filled ones."""
    derived = add_derived(training).select(*(F.col(name).cast("double").alias(name) for name in FEATURES))
    middle = medians(derived, FEATURES)
    missing = [name for name in FEATURES if name not in middle]
    if missing:
        raise ValueError(f"no training value of {', '.join(missing)}")
    filled = derived.select(*(_filled(F.col(name), middle[name]).alias(name) for name in FEATURES))
    row = filled.agg(*(f(name).alias(f"{kind}_{name}") for name in FEATURES for kind, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return middle, {name: (row[f"m_{name}"], row[f"s_{name}"] or 1.0) for name in FEATURES}


def _filled(column: Column, value: float) -> Column:
    return F.coalesce(F.when(~F.isnan(column), column), F.lit(value))


def scaled_name(name: str) -> str:
    return f"{name}_scaled"


def crop_columns(crops: list[str]) -> list[str]:
    return [f"crop_{number}" for number in range(len(crops))]


def prepared_columns(prepared: DataFrame) -> list[str]:
    """The columns that the preprocessor has put into ``features``, in its order."""
    return [*map(scaled_name, FEATURES), *(c for c in prepared.columns if re.fullmatch("crop_[0-9]+", c))]


def preprocessor_stages(training: DataFrame) -> list:
    """Stages that derive, impute, scale and encode; what they need is learnt from the training rows given.

    Medians are exact, by distributed selection; deviations are those of the population. Unknown
    crops encode to all zeros, missing ones are the most frequent crop. The stages hold their
    numbers as literals, so a stored pipeline is plain text.
    """
    middle, scales = fitted_values(training)
    counts = crop_counts(training)
    mode, crops = quoted(_mode(counts)), list(counts)
    derived = ", ".join(f"CAST({text} AS DOUBLE) AS {name}" for name, text in DERIVED.items())
    values = {name: f"CAST({name} AS DOUBLE)" for name in NUMERIC} | {name: name for name in DERIVED}
    scaled = ", ".join(
        f"(coalesce(nullif({values[name]}, double('NaN')), {middle[name]!r}D) - ({scales[name][0]!r}D)) / {scales[name][1]!r}D AS {scaled_name(name)}"
        for name in FEATURES
    )
    encoded = "".join(
        f", if(crop = {quoted(crop)}, 1D, 0D) AS {name}" for crop, name in zip(crops, crop_columns(crops))
    )
    inputs = [*map(scaled_name, FEATURES), *crop_columns(crops)]
    return [
        SQLTransformer(statement=f"SELECT *, {derived}, coalesce({CATEGORICAL}, {mode}) AS crop FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {scaled}{encoded} FROM __THIS__"),
        VectorAssembler(inputCols=inputs, outputCol="features"),
    ]


def build_preprocessor(training: DataFrame) -> Pipeline:
    return Pipeline(stages=preprocessor_stages(training))
