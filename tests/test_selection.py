import math
import random
from statistics import median

import pytest

from sensorloom.operators import selection


def frame_of(spark, groups):
    rows = [(name, value) for name, values in groups.items() for value in values]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "group string, value double").repartition(6)


def groups_of(seed):
    rng = random.Random(seed)
    return {
        "even": [float(rng.randint(-50, 50)) for _ in range(500)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(801)],
        "close": [1.0 + k * 2.0**-52 for k in range(40)] * 3,
        "same": [7.25] * 900,
        "hot": [3.0] * 2_000 + [rng.random() for _ in range(100)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324],
        "one": [-0.5],
        None: [1.0, 2.0, None, math.nan, 4.0],
    }


def kept(values):
    return sorted(v for v in values if v is not None and not math.isnan(v))


@pytest.mark.parametrize("buckets", [1_024, 3])
def test_every_rank_equals_sorting(spark, monkeypatch, buckets):
    monkeypatch.setattr(selection, "BUCKETS", buckets)
    groups = groups_of(4)
    found = selection.order_statistics(frame_of(spark, groups), lambda n: {0, n // 3, (n - 1) // 2, n // 2, n - 1})
    assert set(found) == set(groups)
    for name, values in groups.items():
        ordered = kept(values)
        for rank, at in found[name].items():
            assert at.value == ordered[rank] and at.less == sum(v < at.value for v in ordered)


def test_rounds_do_not_grow_with_rows(spark, monkeypatch):
    calls = []
    plain = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: calls.append(a) or plain(*a, **k))
    for rows in (1_000, 200_000):
        calls.clear()
        values = spark.range(rows).selectExpr("'x' AS group", "CAST(id * 7919 % 1000003 AS DOUBLE) / 3 AS value")
        found = selection.order_statistics(values, lambda n: [n // 2])
        assert found["x"][rows // 2].value == sorted(i * 7919 % 1000003 / 3 for i in range(rows))[rows // 2]
        assert len(calls) <= 4


def test_medians_of_columns(spark):
    rows = [(1.0, 5, None), (2.0, 7, None), (None, 8, None), (math.nan, 100, None)]
    frame = spark.createDataFrame(rows, "a double, b int, c double")
    assert selection.medians(frame, ["a", "b", "c"]) == {"a": median([1.0, 2.0]), "b": 7.5}
    assert selection.medians(frame.limit(0), ["a", "b"]) == {}


def test_refusals(spark):
    with pytest.raises(ValueError, match="infinite"):
        selection.order_statistics(frame_of(spark, {"x": [1.0, math.inf]}), lambda n: [0])
    with pytest.raises(ValueError, match="wanted ranks"):
        selection.order_statistics(frame_of(spark, {"x": [1.0]}), lambda n: [1])


def test_values_of_all_sizes_take_few_rounds(spark, monkeypatch):
    """An interval of few values is settled by one round, however uneven the values are."""
    calls = []
    plain = spark.createDataFrame
    wide = [10.0 ** (k / 2 - 300) for k in range(1_000)]
    frame = frame_of(spark, {"x": wide})
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: calls.append(a) or plain(*a, **k))
    found = selection.order_statistics(frame, lambda n: [100, 500])
    assert {rank: at.value for rank, at in found["x"].items()} == {100: wide[100], 500: wide[500]} and len(calls) == 1


def test_medians_equal_sorting_without_multiplied_rows(spark, monkeypatch):
    groups = {name: kept(values) for name, values in groups_of(5).items() if name}
    rows = [tuple(v[i] if i < len(v) else None for v in groups.values()) for i in range(max(map(len, groups.values())))]
    frame = spark.createDataFrame(rows, ", ".join(f"`{name}` double" for name in groups)).repartition(3)
    exploded = []
    monkeypatch.setattr(selection.F, "explode", lambda x: exploded.append(x))
    assert selection.medians(frame, list(groups)) == {name: median(values) for name, values in groups.items()}
    assert not exploded
