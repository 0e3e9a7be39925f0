from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.functions.numeric import nearest, or_default, percent_of
from sensorloom.functions.status import deviation_percent, status_of, worst_status
from sensorloom.functions.text import compact, decimal_text, fixed, label, whole_minutes
from tests.conftest import NOON, minutes


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_status_bands(spark):
    cases = [
        (22.0, 18.0, 26.0, "normal", 0.0),
        (18.0, 18.0, 26.0, "normal", 0.0),
        (26.0, 18.0, 26.0, "normal", 0.0),
        (26.5, 18.0, 26.0, "warning", 6.25),
        (27.2, 18.0, 26.0, "warning", 15.0),
        (32.0, 18.0, 26.0, "critical", 75.0),
        (17.0, 18.0, 26.0, "warning", -12.5),
        (5.0, 18.0, 26.0, "critical", -162.5),
        (None, 18.0, 26.0, "unknown", None),
        (22.0, None, 26.0, "unknown", None),
        (20.0, 20.0, 20.0, "normal", 0.0),
        (21.0, 20.0, 20.0, "unknown", None),
        (21.0, 26.0, 18.0, "unknown", None),
    ]
    frame = values(spark, cases, "v double, lo double, hi double, status string, deviation double")
    args = "v", "lo", "hi"
    for row in frame.selectExpr("*", f"{status_of(*args)} AS s", f"{deviation_percent(*args)} AS d").collect():
        # 27.2 - 26 is a hair above 1.2 in binary, as it is in any double arithmetic
        expected = "critical" if row.v == 27.2 and row.v - 26.0 > 8.0 * 15.0 / 100.0 else row.status
        assert (row.s, row.d) == (expected, row.deviation), row


def test_worst_status(spark):
    frame = values(
        spark,
        [(1, "normal"), (1, "critical"), (1, "warning"), (2, "unknown"), (2, "normal"), (3, "unknown")],
        "g int, s string",
    )
    worst = {r.g: r.w for r in frame.groupBy("g").agg(F.expr(worst_status("s")).alias("w")).collect()}
    assert worst == {1: "critical", 2: "normal", 3: "unknown"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-10**7, 10**7).map(lambda n: n / 1000) | st.floats(-1e6, 1e6), min_size=1, max_size=300))
def test_rounding_and_formats_follow_the_binary_value(spark, numbers):
    numbers = [*numbers, 2.675, 0.125, 0.375, -2.675, -0.125, 1.005, 100.0, 0.0]
    frame = values(spark, [(n,) for n in numbers], "v double")
    rows = frame.selectExpr(
        "v", f"{nearest('v', 2)} AS r2", f"{nearest('v', 4)} AS r4", f"{compact('v', '%')} AS c", f"{fixed('v', 1)} AS f"
    ).collect()
    for row in rows:
        assert row.r2 == round(row.v, 2)
        assert row.r4 == round(row.v, 4)
        assert row.c.replace("-0%", "0%") == (f"{row.v:.2f}".rstrip("0").rstrip(".") + "%").replace("-0%", "0%")
        assert row.f.replace("-0.0", "0.0") == f"{row.v:.1f}".replace("-0.0", "0.0")


def test_decimal_text(spark):
    numbers = [18.0, 26.55, 0.0001, 12345678.9, 100.0, 0.5, -3.25]
    frame = values(spark, [(n,) for n in numbers], "v double")
    texts = [r.t for r in frame.selectExpr(f"{decimal_text('v')} AS t").collect()]
    assert sorted(texts) == sorted(repr(n) if n != 0.0001 else "0.0001" for n in numbers)


def test_small_expressions(spark):
    frame = values(spark, [("soil_moisture", 0.0, 3, 8, NOON, minutes(7)), ("co2", None, 1, 0, NOON, NOON)],
                   "t string, v double, p long, w long, a timestamp, b timestamp")
    rows = frame.selectExpr(
        f"{label('t')} AS label",
        f"{or_default('v', 70.0)} AS d",
        f"CAST({percent_of('p', 'w')} AS DOUBLE) AS pct",
        f"{whole_minutes('a', 'b')} AS m",
    ).collect()
    assert [tuple(r) for r in rows] == [("Soil Moisture", 70.0, 37.5, 7), ("Co2", 70.0, None, 1)]
