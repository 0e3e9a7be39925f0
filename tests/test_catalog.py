"""Every named query against its SQL in DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from sensorloom.operators.yields import features, train
from sensorloom.plans import catalog, oracle
from tools.check import compare

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="no test tables")

QUERIES, STATEMENTS = catalog.callables(), oracle.statements()
ROWS_ONLY = {"yield_linear", "yield_leaderboard", "yield_scores"}


def test_every_statement_belongs_to_a_query():
    assert set(QUERIES) - set(STATEMENTS) == ROWS_ONLY
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, DIRECTORY, name, QUERIES[name], STATEMENTS[name]) is None


def test_the_comparison_sees_a_difference(spark):
    changed = STATEMENTS["readings_total"].replace("count(*)", "count(*) + 1")
    assert compare(spark, DIRECTORY, "x", QUERIES["readings_total"], changed) is not None
    assert duckdb.sql("SELECT 1").fetchall() == [(1,)]


def test_the_flagship_runs(spark):
    assert entry_points.entry(spark).count() == 888


def test_linear_predictions_equal_a_plain_solver(spark):
    star = catalog.Star(spark, DIRECTORY)
    names = [c for c in star.prepared.columns if c.endswith("_scaled") or c.startswith("crop_") and c != "crop_type"]
    rows = star.prepared.select("record_id", "split", features.TARGET, *names).toPandas()
    table = np.column_stack([np.ones(len(rows)), rows[names].to_numpy()])
    training = (rows.split == "train").to_numpy()
    weights = np.linalg.lstsq(table[training], rows[features.TARGET].to_numpy()[training], rcond=1e-10)[0]
    found = QUERIES["yield_linear"](spark, DIRECTORY).toPandas().set_index("record_id").loc[rows.record_id]
    assert np.abs(found.predicted_yield.to_numpy() - table @ weights).max() < 1e-8
    assert len(found) == QUERIES["yield_features"](spark, DIRECTORY).count()


def test_yield_queries_fit_every_training_row(spark, monkeypatch):
    linear = {"linear_regression": train.build_estimators()["linear_regression"]}
    monkeypatch.setattr(train, "build_estimators", lambda: linear)
    training = QUERIES["yield_split"](spark, DIRECTORY).filter("split = 'train'").count()
    fitted = catalog.Star(spark, DIRECTORY).trained.fitted["linear_regression"]
    assert fitted.stages[0].summary.numInstances == training > 2_000
    accepted = QUERIES["yield_request_validation"](spark, DIRECTORY).filter("accepted").count()
    assert QUERIES["yield_leaderboard"](spark, DIRECTORY).filter("selected").count() == 1
    assert QUERIES["yield_scores"](spark, DIRECTORY).count() == accepted


def test_the_yield_queries_read_the_order_lines_once(spark):
    """What a fit reads again and again is the stored fold of the lines."""
    star = catalog.Star(spark, DIRECTORY)
    assert not any("lineitem" in file for file in star.incomplete.inputFiles())
    assert star.incomplete.count() == star.records.count()


def test_steady_is_round_at_a_small_cost(spark):
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, -2.5e-6, 1.2345674999, 2.675, -1e-7, 1e300, float("inf"), float("nan"), None, 123456.7654325]
    values += [k * 0.000000499999 - 3 for k in range(2_000)] + [k / 2e6 - 1e-9 for k in range(-500, 500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    by_round = [r[0] for r in frame.select(F.round(F.col("v") + 1e-9, 6)).collect()]
    plan = frame.select(catalog.steady("v", 6))
    assert [str(r[0]) for r in plan.collect()] == [str(v) for v in by_round]
    assert "CASE WHEN" in plan._jdf.queryExecution().toString()
