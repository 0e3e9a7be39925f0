import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom import schemas  # noqa: E402
from sensorloom.session import local_session  # noqa: E402

DAY = datetime(2020, 6, 1, tzinfo=timezone.utc)
NOON = DAY + timedelta(hours=12)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, shuffle_partitions=2)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


class Fleet:
    """Small literal tables: one site per ten zones, one zone per ten sensor ids."""

    def __init__(self, spark):
        self.spark = spark

    def greenhouses(self, *ids):
        return self.spark.createDataFrame([(i, f"Site {i}", f"place {i}", "active", DAY, DAY) for i in ids], schemas.GREENHOUSES)

    def zones(self, *ids, crop="tomato", greenhouse=1, temperature=(18, 26), humidity=(60, 80), soil=(55, 75)):
        from decimal import Decimal

        def d(x):
            return None if x is None else Decimal(str(x))

        rows = [
            (i, greenhouse, f"Zone {i}", crop, *map(d, temperature), *map(d, humidity), *map(d, soil)) for i in ids
        ]
        return self.spark.createDataFrame(rows, schemas.ZONES)

    def sensors(self, *rows):
        """Rows of (id, zone_id, sensor_type)."""
        units = {"temperature": "C", "light": "lux", "co2": "ppm", "irrigation": "L/min"}
        return self.spark.createDataFrame(
            [(i, z, t, units.get(t, "%"), "active", DAY) for i, z, t in rows], schemas.SENSORS
        )

    def readings(self, *rows):
        """Rows of (sensor_id, timestamp, value) or (id, sensor_id, timestamp, value)."""
        from decimal import Decimal

        full = [row if len(row) == 4 else (i, *row) for i, row in enumerate(rows, 1)]
        return self.spark.createDataFrame(
            [(i, s, t, None if v is None else Decimal(str(v))) for i, s, t, v in full], schemas.READINGS
        )

    def alerts(self, *rows):
        """Rows of dicts; the rest is filled in."""
        base = {
            "greenhouse_id": 1, "zone_id": 1, "sensor_id": 1, "alert_type": "threshold_high", "severity": "warning",
            "status": "open", "message": "old", "value": None, "threshold": "old", "created_at": DAY,
            "acknowledged_at": None, "resolved_at": None,
        }
        names = schemas.ALERTS.fieldNames()
        filled = [{**base, "id": i, **row} for i, row in enumerate(rows, 1)]
        return self.spark.createDataFrame([tuple(f[n] for n in names) for f in filled], schemas.ALERTS)

    def recommendations(self, *rows):
        base = {
            "greenhouse_id": 1, "zone_id": 1, "sensor_id": 1, "recommendation_type": "irrigation_needed",
            "priority": "high", "status": "open", "message": "old", "reason": "old", "created_at": DAY,
            "updated_at": DAY, "resolved_at": None,
        }
        names = schemas.RECOMMENDATIONS.fieldNames()
        filled = [{**base, "id": i, **row} for i, row in enumerate(rows, 1)]
        return self.spark.createDataFrame([tuple(f[n] for n in names) for f in filled], schemas.RECOMMENDATIONS)


@pytest.fixture(scope="session")
def fleet(spark):
    return Fleet(spark)


def settled(frame):
    """The same rows as literals, so that a chain of steps does not grow one plan."""
    return frame.sparkSession.createDataFrame(frame.collect(), frame.schema)


def minutes(n):
    return NOON - timedelta(minutes=n)


def hours(n):
    return NOON - timedelta(hours=n)
