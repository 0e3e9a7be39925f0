import random
import statistics
from datetime import timedelta
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators import cleaning
from sensorloom.operators.joins import lookup_join
from tests.conftest import DAY, minutes


def brute_force(rows, frame=59, z=5.0):
    """Per sensor, by time: (sensor, time) to mean, deviation and flag."""
    out = {}
    for sensor in {r[0] for r in rows}:
        series = sorted((t, v) for s, t, v in rows if s == sensor)
        for i, (t, v) in enumerate(series):
            before = [x for _, x in series[max(0, i - frame):i]]
            mean = statistics.fmean(before) if before else None
            std = statistics.pstdev(before) if before else None
            out[sensor, t] = mean, std, bool(std and std > 0 and abs((v - mean) / std) > z)
    return out


def skewed_series(seed=3):
    """One sensor with most rows, bursts and long gaps; a few with little."""
    rng = random.Random(seed)
    rows, at = [], DAY
    for i in range(900):
        at += timedelta(seconds=rng.choice([1, 5, 60, 4000]))
        rows.append((1, at, round(rng.gauss(20, 2) + (40 if i % 97 == 50 else 0), 2)))
    for sensor in (2, 3):
        for i in range(70):
            rows.append((sensor, DAY + timedelta(hours=7 * i), round(rng.uniform(0, 30), 2)))
    rows.append((4, DAY, 5.0))
    return rows


@pytest.mark.parametrize("block_rows", [59, 60, 137, 250_000])
def test_blocks_do_not_change_the_rolling_result(spark, fleet, block_rows):
    rows = skewed_series()
    frame = cleaning.normalise(fleet.readings(*rows))
    result = cleaning.rolling_statistics(frame, block_rows=block_rows)
    flag = cleaning.is_outlier(F.col("value"), F.col("rolling_mean"), F.col("rolling_std"), 5.0)
    found = result.withColumn("flag", flag).collect()
    expected = brute_force(rows)
    assert len(found) == len(rows)
    for row in found:
        mean, std, outlier = expected[row.sensor_id, row.timestamp.astimezone(DAY.tzinfo)]
        assert row.flag == outlier
        assert row.rolling_mean == (None if mean is None else pytest.approx(mean))
        assert row.rolling_std == (None if std is None else pytest.approx(std, abs=1e-9))
    assert any(r.flag for r in found)


def test_large_values_with_a_small_spread(fleet):
    """The deviation is exact where a float sum of squares would have no digits left."""
    rng = random.Random(9)
    rows = [(1, minutes(200 - i), round(99_999_000 + rng.randint(0, 3) / 10_000, 4)) for i in range(150)]
    rows += [(2, minutes(200 - i), round(-70_000.5 + rng.randint(-3, 3) / 10_000, 4)) for i in range(150)]
    rows += [(3, minutes(200 - i), 199_999.9999) for i in range(70)]
    expected = brute_force_exact(rows)
    for row in cleaning.rolling_statistics(cleaning.normalise(fleet.readings(*rows)), block_rows=61).collect():
        mean, std = expected[row.sensor_id, row.timestamp.astimezone(DAY.tzinfo)]
        assert row.rolling_mean == (None if mean is None else pytest.approx(mean, rel=1e-15))
        assert row.rolling_std == (None if std is None else pytest.approx(std, rel=1e-12, abs=0))


def brute_force_exact(rows, frame=59):
    out = {}
    for sensor in {r[0] for r in rows}:
        series = sorted((t, Fraction(str(v))) for s, t, v in rows if s == sensor)
        for i, (t, _) in enumerate(series):
            before = [x for _, x in series[max(0, i - frame):i]]
            mean = sum(before) / len(before) if before else None
            std = None if mean is None else float(sum((x - mean) ** 2 for x in before) / len(before)) ** 0.5
            out[sensor, t] = (None if mean is None else float(mean)), std
    return out


@pytest.mark.parametrize("copies", [1, 30])
@pytest.mark.parametrize("block_rows", [59, 83, 400])
def test_blocks_hold_their_own_rows_and_the_frame_before_them(fleet, block_rows, copies):
    rows = skewed_series() + [(5, DAY + timedelta(milliseconds=20 * i), 1.0) for i in range(1200)]
    frame = fleet.readings(*rows)
    times = frame.withColumn("n", F.explode(F.expr(f"sequence(1, if(id % 3 = 0, {copies}, 1))")))
    found = cleaning.in_blocks(frame, 59, block_rows, times).select("sensor_id", "timestamp", "_block", "_own").collect()
    for sensor in range(1, 6):
        times = sorted(t for s, t, _ in rows if s == sensor)
        own = {r.timestamp.astimezone(DAY.tzinfo): r._block for r in found if r.sensor_id == sensor and r._own}
        assert sorted(own) == times and len([r for r in found if r.sensor_id == sensor and r._own]) == len(times)
        for block in set(own.values()):
            held = sorted(r.timestamp.astimezone(DAY.tzinfo) for r in found if r.sensor_id == sensor and r._block == block)
            first = times.index(min(t for t in times if own[t] == block))
            last = times.index(max(t for t in times if own[t] == block))
            start = times.index(held[0])
            assert held == times[start:last + 1] and start <= max(0, first - 59)
            assert len(held) <= block_rows + 59 + 250


def test_a_hot_hour_is_several_blocks(spark):
    """400,000 readings of one sensor in one hour: no block has them all, and the result is the plain window's."""
    readings = spark.range(400_000).selectExpr(
        "id", "1 AS sensor_id", "timestamp_micros(1591000000000000 + id * 8000) AS timestamp",
        "CAST(round(20 + sin(id) * 3 + if(id % 9973 = 0, 30, 0), 2) AS DOUBLE) AS value",
    )
    found = cleaning.rolling_statistics(readings, block_rows=50_000)
    own = cleaning.in_blocks(readings, 59, 50_000).groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_own").alias("own"))
    sizes = own.collect()
    assert len(sizes) >= 8 and sum(r.own for r in sizes) == 400_000 and max(r.n for r in sizes) <= 50_500
    frame = Window.partitionBy("sensor_id").orderBy("timestamp").rowsBetween(-59, -1)
    plain = readings.select("id", F.avg("value").over(frame).alias("m"), F.stddev_pop("value").over(frame).alias("s"))
    off = found.join(plain, "id").filter(
        "NOT (rolling_mean <=> m OR abs(rolling_mean - m) < 1e-9) OR NOT (rolling_std <=> s OR abs(rolling_std - s) < 1e-7)"
    )
    assert found.count() == 400_000 and off.count() == 0


def test_values_that_are_no_numbers_do_not_count_in_frames(spark):
    rows = [(i, 1, minutes(50 - i), v) for i, v in enumerate([1.0, float("nan"), 3.0, float("inf"), 1e300, None, 5.0])]
    frame = spark.createDataFrame(rows, "id long, sensor_id int, timestamp timestamp, value double")
    found = {r.id: (r.rolling_mean, r.rolling_std) for r in cleaning.rolling_statistics(frame).collect()}
    assert found[0] == (None, None) and found[2] == (1.0, 0.0)
    assert all(found[i] == (2.0, 1.0) for i in (3, 4, 5, 6))


def test_a_pile_of_copies_leaves_one_reading(fleet):
    rows = [(i, 1, DAY, 20.0 + i % 7) for i in range(1, 600)] + [(1000 + i, 2, minutes(i), 21.0) for i in range(300)]
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "temperature"))
    clean = cleaning.clean_readings(fleet.readings(*rows), sensors, block_rows=70)
    assert clean.count() == 301
    assert clean.filter("sensor_id = 1").first().id == 599


def test_a_block_must_hold_a_frame(fleet):
    for size in (58, cleaning.MOST_BLOCK_ROWS + 1):
        with pytest.raises(ValueError):
            cleaning.rolling_statistics(fleet.readings((1, DAY, 1.0)), block_rows=size)


def test_cleaning_rules(fleet):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"), (3, 1, "pressure"))
    readings = fleet.readings(
        (1, 1, minutes(9), 20.0),
        (2, 1, minutes(9), 21.0),  # newer copy wins
        (3, 1, minutes(8), 22.0),
        (4, 1, minutes(8), 99.0),  # impossible newest copy must not hide the valid one
        (5, 2, minutes(7), 100.0),  # upper bound is allowed
        (6, 2, minutes(6), 100.5),
        (7, 3, minutes(5), 10.0),  # type without bounds
        (8, 9, minutes(4), 10.0),  # unknown sensor
        (9, None, minutes(4), 10.0),
        (10, 1, None, 10.0),
        (11, 1, minutes(3), None),
    )
    clean = cleaning.clean_readings(readings, sensors)
    assert sorted((r.id, r.sensor_type, r.value, r.is_outlier) for r in clean.collect()) == [
        (2, "temperature", 21.0, False),
        (3, "temperature", 22.0, False),
        (5, "humidity", 100.0, False),
    ]
    assert clean.dtypes == [
        ("id", "bigint"), ("sensor_id", "int"), ("sensor_type", "string"),
        ("timestamp", "timestamp"), ("value", "double"), ("is_outlier", "boolean"),
    ]


def test_constant_history_flags_nothing(fleet):
    rows = [(1, minutes(100 - i), 22.0) for i in range(60)] + [(1, minutes(1), 60.0)]
    clean = cleaning.clean_readings(fleet.readings(*rows), fleet.sensors((1, 1, "temperature")))
    assert clean.filter("is_outlier").count() == 0


def test_earlier_outliers_stay_in_later_frames(fleet):
    values = [20.0, 21.0] * 20 + [70.0, 70.0]
    rows = [(1, minutes(100 - i), v) for i, v in enumerate(values)]
    clean = cleaning.clean_readings(fleet.readings(*rows), fleet.sensors((1, 1, "temperature")))
    flags = [r.is_outlier for r in clean.orderBy("timestamp").collect()]
    expected = brute_force(rows)
    assert flags == [expected[1, t][2] for _, t, _ in rows]
    assert flags[-2] and sum(flags) >= 1


def test_copies_are_reduced_before_the_exchange(fleet):
    plan = cleaning.keep_newest(fleet.readings((1, DAY, 1.0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join(spark, fleet, how, threshold):
    rows = [(1, minutes(i), float(i)) for i in range(50)] + [(2, minutes(1), 1.0), (9, minutes(1), 1.0)]
    facts = fleet.readings(*rows)
    dim = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"), (3, 1, "co2")).select(
        F.col("id").alias("sensor_id"), "sensor_type"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        ours = lookup_join(facts, dim, "sensor_id", how)
        plain = facts.join(dim, "sensor_id", how)
        assert ours.columns == plain.columns
        assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_join_broadcasts_the_dimension_as_it_is(spark, fleet, capsys, tmp_path):
    dim = fleet.sensors((1, 1, "temperature")).select(F.col("id").alias("sensor_id"), "sensor_type")
    dim.write.parquet(f"{tmp_path}/dim")  # a file has a size, a list of rows has none
    dim = spark.read.parquet(f"{tmp_path}/dim")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold, join in (("10MB", "BroadcastHashJoin"), ("-1", "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            lookup_join(fleet.readings(), dim, "sensor_id").explain()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        plan = capsys.readouterr().out
        assert join in plan and "Generate" not in plan


def test_lookup_join_refuses_kinds_whose_facts_cannot_be_split(fleet):
    with pytest.raises(ValueError):
        lookup_join(fleet.readings(), fleet.sensors(), "id", "full_outer")
