from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import quality
from sensorloom.plans import batch
from sensorloom.sources import files
from sensorloom.sources.jdbc import JdbcTable, read_jdbc
from tests.conftest import DAY, NOON


def sources(fleet, **changed):
    readings = [(1, DAY + timedelta(minutes=7 * i), 20.0 + i % 5) for i in range(300)]
    readings += [(2, DAY + timedelta(hours=i), 65.0) for i in range(30)] + [(2, DAY, 66.0)]
    base = {
        "greenhouses": fleet.greenhouses(1), "zones": fleet.zones(1, 2),
        "sensors": fleet.sensors((1, 1, "temperature"), (2, 2, "humidity")), "readings": fleet.readings(*readings),
    }
    return batch.Sources(**{**base, **changed})


def test_refresh_writes_and_is_repeatable(spark, fleet, tmp_path):
    out = str(tmp_path)
    counts = batch.refresh(sources(fleet), out, NOON)
    assert counts["sensor_readings_clean"] == counts["marts.fact_sensor_readings"] == 330
    assert counts["marts.dim_date"] == 2 and counts["marts.sensor_health_summary"] == 2
    first = sorted(map(str, spark.read.parquet(f"{out}/marts/daily_greenhouse_metrics").collect()))
    assert batch.refresh(sources(fleet), out, NOON) == counts
    assert sorted(map(str, spark.read.parquet(f"{out}/marts/daily_greenhouse_metrics").collect())) == first
    clean = spark.read.parquet(f"{out}/staging/sensor_readings_clean")
    assert clean.filter((F.col("sensor_id") == 2) & (F.col("timestamp") == DAY)).first().value == 66.0


def test_refresh_raises_on_a_broken_constraint(fleet, tmp_path):
    odd = sources(fleet, zones=fleet.zones(1, 2, crop="kale"))
    with pytest.raises(quality.QualityError, match="accepted_values:dim_zone.crop_type: 2"):
        batch.refresh(odd, str(tmp_path), NOON)


def test_partition_replacement_keeps_other_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"2020-06-0{1 + i % 3}") for i in range(9)], "v int, day string")
    assert files.write_table(rows, path, ("day",), ("v",)) == 9
    later = spark.createDataFrame([(100, "2020-06-02")], "v int, day string")
    assert files.write_table(later, path, ("day",), replace="partitions") == 1
    assert {r.day.isoformat() if hasattr(r.day, "isoformat") else r.day: r.n for r in spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n")).collect()} == {
        "2020-06-01": 3, "2020-06-02": 1, "2020-06-03": 3,
    }
    assert files.write_table(later, path, ("day",)) == 1
    assert spark.read.parquet(path).count() == 1


def test_views_show_only_their_columns(spark, fleet):
    files.register_views({"raw_sensors": fleet.sensors((1, 1, "co2"))}, {"raw_sensors": ("id", "sensor_type")})
    assert spark.sql("SELECT * FROM raw_sensors").columns == ["id", "sensor_type"]


def test_jdbc_options():
    plain = JdbcTable("jdbc:x", "readings", {"user": "u"})
    assert "numPartitions" not in plain.read_options() and plain.read_options()["user"] == "u"
    split = JdbcTable("jdbc:x", "readings", {}, "id", 0, 1000, partitions=8)
    assert {k: split.read_options()[k] for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")} == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "8",
    }
    assert split.write_options()["truncate"] == "true"
    with pytest.raises(ValueError):
        JdbcTable("jdbc:x", "readings", {}, "id").read_options()


def test_jdbc_tables_are_read_by_one_task_only_when_asked_for(spark):
    with pytest.raises(ValueError, match="partition column"):
        read_jdbc(spark, JdbcTable("jdbc:x", "readings"))
    assert "numPartitions" not in JdbcTable("jdbc:x", "sites", single_task=True).read_options()


def test_column_checks_are_one_scan_with_a_row_each(spark, capsys):
    frame = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (None, "z")], "k int, v string")
    checks = quality.column_checks(frame, "t", ("k", "v"), {"v": ("a", "b")})
    checks.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") == 1
    assert [tuple(r) for r in checks.collect()] == [
        ("not_null:t.k", 2, False), ("not_null:t.v", 1, False), ("accepted_values:t.v", 1, False),
    ]
    singly = [quality.not_null(frame, ["k"], "t.k"), quality.not_null(frame, ["v"], "t.v"), quality.accepted_values(frame, "v", ("a", "b"), "t.v")]
    assert quality.combine(singly).collect() == checks.collect()
    empty = quality.column_checks(frame.limit(0), "t", ("k",))
    assert [tuple(r) for r in empty.collect()] == [("not_null:t.k", 0, True)]
