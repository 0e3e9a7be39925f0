"""Validation of prediction inputs and batch scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.numeric import at_least_zero, nearest, or_default

# Crops a model knows and the closed range of each numeric input.
CROPS = ("Tomato", "Cucumber", "Lettuce", "Pepper")
INPUT_RANGES: dict[str, tuple[float, float]] = {
    "avg_temperature_C": (-10.0, 50.0),
    "min_temperature_C": (-20.0, 40.0),
    "max_temperature_C": (-5.0, 60.0),
    "humidity_percent": (0.0, 100.0),
    "co2_ppm": (0.0, 5000.0),
    "light_intensity_lux": (0.0, 100000.0),
    "photoperiod_hours": (0.0, 24.0),
    "irrigation_mm": (0.0, 100.0),
    "fertilizer_N_kg_ha": (0.0, 500.0),
    "fertilizer_P_kg_ha": (0.0, 300.0),
    "fertilizer_K_kg_ha": (0.0, 400.0),
    "pest_severity": (0.0, 10.0),
    "soil_pH": (3.0, 10.0),
    "days_to_maturity": (1, 365),
}


# Inputs no sensor measures.
TYPICAL_INPUTS = {
    "photoperiod_hours": "14.0D",
    "irrigation_mm": "5.0D",
    "fertilizer_N_kg_ha": "120.0D",
    "fertilizer_P_kg_ha": "60.0D",
    "fertilizer_K_kg_ha": "80.0D",
    "pest_severity": "2.0D",
    "soil_pH": "6.5D",
    "days_to_maturity": "90",
}


def _failures() -> str:
    """Names of the input fields that are missing or out of range."""
    crops = ", ".join(f"'{crop}'" for crop in CROPS)
    tests = {"crop_type": f"crop_type IN ({crops})"} | {
        name: f"{name} BETWEEN {low} AND {high}" for name, (low, high) in INPUT_RANGES.items()
    }
    fields = ", ".join(f"if(coalesce({test}, false), NULL, '{name}')" for name, test in tests.items())
    return f"array_compact(array({fields}))"


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``failures`` and ``accepted``; filter on the latter for the two frames."""
    return requests.withColumn("failures", F.expr(_failures())).withColumn("accepted", F.expr("size(failures) = 0"))


def zone_yield_inputs(zones: DataFrame) -> DataFrame:
    """Prediction inputs of each zone of the wide view, from its current conditions.

    A zone needs temperature, humidity and soil sensors and a temperature; readings of
    zero count as missing. The remaining inputs are typical growing conditions. Zones
    whose inputs are out of range are left out.
    """
    temperature = or_default("temperature_value", 22.0)
    measured = zones.filter(
        "temperature_sensor_id IS NOT NULL AND humidity_sensor_id IS NOT NULL "
        "AND soil_moisture_sensor_id IS NOT NULL AND temperature_value IS NOT NULL"
    )
    inputs = measured.selectExpr(
        "zone_id",
        "if(coalesce(crop_type, '') = '', 'Tomato', "
        "concat(upper(left(crop_type, 1)), lower(substring(crop_type, 2)))) AS crop_type",
        f"{temperature} AS avg_temperature_C",
        f"{temperature} - 5D AS min_temperature_C",
        f"{temperature} + 5D AS max_temperature_C",
        f"{or_default('humidity_value', 70.0)} AS humidity_percent",
        f"{or_default('co2_value', 800.0)} AS co2_ppm",
        f"{or_default('light_value', 20000.0)} AS light_intensity_lux",
        *[f"{value} AS {name}" for name, value in TYPICAL_INPUTS.items()],
    )
    return validate_requests(inputs).filter("accepted").drop("accepted", "failures")


def score(model: PipelineModel, requests: DataFrame, key: str = "record_id") -> DataFrame:
    """Predicted yields of any number of requests, never negative, four decimals."""
    predicted = at_least_zero(nearest("prediction", 4))
    return model.transform(requests).selectExpr(key, f"{predicted} AS predicted_yield")
