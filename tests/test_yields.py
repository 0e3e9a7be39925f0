import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators.yields import evaluate, features, linear, score, split, train
from sensorloom.sources import files


def record(rng, crop=None):
    average = rng.uniform(16, 30)
    light = rng.uniform(8000, 40000)
    row = {
        "crop_type": crop or rng.choice(["Tomato", "Cucumber", "Lettuce", "Pepper"]),
        "avg_temperature_C": average, "min_temperature_C": average - 6, "max_temperature_C": average + 6,
        "humidity_percent": rng.uniform(50, 90), "co2_ppm": rng.uniform(400, 1200), "light_intensity_lux": light,
        "photoperiod_hours": rng.uniform(10, 16), "irrigation_mm": rng.uniform(2, 9),
        "fertilizer_N_kg_ha": rng.uniform(60, 200), "fertilizer_P_kg_ha": rng.uniform(30, 100),
        "fertilizer_K_kg_ha": rng.uniform(40, 150), "pest_severity": rng.uniform(0, 8), "soil_pH": rng.uniform(5.5, 7.5),
        "days_to_maturity": rng.randint(60, 120),
    }
    row["yield_kg_per_m2"] = 3 - abs(average - 23) / 5 + light / 20000 - row["pest_severity"] / 10
    return row


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(11)
    rows = [record(rng) for _ in range(200)]
    frame = spark.createDataFrame([tuple(r[n] for n in schemas.YIELD_RECORDS.fieldNames()) for r in rows], schemas.YIELD_RECORDS)
    return frame.withColumn("record_id", F.monotonically_increasing_id()).cache()


def test_derived_features(spark):
    row = record(random.Random(1), "Tomato") | {
        "avg_temperature_C": 24.0, "min_temperature_C": 18.0, "max_temperature_C": 30.0, "light_intensity_lux": 20000.0,
        "photoperiod_hours": 14.0, "fertilizer_N_kg_ha": 120.0, "fertilizer_P_kg_ha": 60.0, "fertilizer_K_kg_ha": 80.0,
    }
    names = schemas.YIELD_RECORDS.fieldNames()
    derived = features.add_derived(spark.createDataFrame([tuple(row[n] for n in names)], schemas.YIELD_RECORDS)).first()
    assert (derived.temp_range_C, derived.temp_deviation_C) == (12.0, 1.0)
    assert (derived.light_daily_integral, derived.nutrient_total_kg_ha) == (280000.0, 260.0)


def test_preprocessing_imputes_scales_and_encodes(spark, records):
    model = features.build_preprocessor(records).fit(records)
    holes = records.limit(3).withColumns({"co2_ppm": F.lit(None).cast("double"), "crop_type": F.lit("Kale")})
    size = len(features.FEATURES) + 4
    for frame, encoded in ((records, 1.0), (holes, 0.0)):
        for row in model.transform(frame).select(vector_to_array("features").alias("f")).collect():
            assert len(row.f) == size and not any(math.isnan(x) for x in row.f)
            assert sum(row.f[-4:]) == encoded
    means = model.transform(records).select(vector_to_array("features").alias("f")).agg(F.avg(F.col("f")[0]), F.stddev_pop(F.col("f")[0])).first()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(1)


def test_a_missing_crop_becomes_the_most_frequent(records):
    top = features.most_frequent_crop(records)
    model = features.build_preprocessor(records).fit(records)
    blank = records.limit(1).withColumn("crop_type", F.lit(None).cast("string"))
    same = records.limit(1).withColumn("crop_type", F.lit(top))
    assert model.transform(blank).first().features == model.transform(same).first().features


def test_the_split_is_exact_in_every_stratum(spark):
    sizes = {"a": 10_000, "b": 1_003, "c": 10, "d": 4, "e": 3, "f": 1, None: 57}
    rows = [(f"{crop}{i}", crop) for crop, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "name string, crop string").repartition(5)
    parts = split.assign_split(frame, "name", by="crop").collect()
    assert len(parts) == len(rows)
    for crop, n in sizes.items():
        held = (15 * n + 50) // 100
        own = [r.split for r in parts if r.crop == crop]
        assert (own.count("train"), own.count("validation"), own.count("test")) == (n - 2 * held, held, held)
    again = {r.name: r.split for r in split.assign_split(frame.sort("name"), "name", by="crop").collect()}
    assert again == {r.name: r.split for r in parts}
    other = {r.name: r.split for r in split.assign_split(frame, "name", seed=7, by="crop").collect()}
    assert other != again


def test_digests_that_collide_are_cut_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(split, "_place", lambda key, seed: F.lit(5.0))
    frame = spark.range(100).select("id", F.lit("x").alias("crop"))
    found = {r.id: r.split for r in split.assign_split(frame, "id", by="crop").collect()}
    assert [found[i] for i in (0, 69, 70, 84, 85, 99)] == ["train", "train", "validation", "validation", "test", "test"]
    assert split.assign_split(frame.limit(0), "id", by="crop").count() == 0


def test_least_squares_with_collinear_columns(spark):
    rng = np.random.default_rng(3)
    table = rng.normal(size=(300, 3))
    table = np.column_stack([table, table[:, 0] + table[:, 1], np.ones(300)])
    label = table @ [1.0, -2.0, 0.5, 0.3, 0.0] + 4 + rng.normal(size=300) / 10
    names = ["a", "b", "c", "d", "e"]
    frame = spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(table, label)], [*names, "y"])
    model = linear.fit(frame.repartition(4), "y", names)
    full = np.column_stack([np.ones(300), table])
    weights = np.linalg.lstsq(full, label, rcond=None)[0]
    found = np.array([r.p for r in frame.select(model.predict().alias("p")).collect()])
    assert np.abs(found - full @ weights).max() < 1e-9
    with pytest.raises(ValueError, match="no rows"):
        linear.fit(frame.limit(0), "y", names)


def metrics(spark, pairs):
    frame = spark.createDataFrame(pairs, "y double, p double")
    return evaluate.regression_metrics(frame, "y", "p").first()


def test_metrics(spark):
    perfect = metrics(spark, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)])
    assert (perfect.mae, perfect.rmse, perfect.r2, perfect.mape) == (0.0, 0.0, 1.0, 0.0)
    near = metrics(spark, [(1.0, 1.1), (2.0, 1.9), (3.0, 3.1), (4.0, 3.8)])
    assert near.r2 == pytest.approx(1 - 0.07 / 5.0) and near.mae == pytest.approx(0.125)
    some_zero = metrics(spark, [(0.0, 1.0), (2.0, 1.0)])
    assert some_zero.mape == pytest.approx(50.0)
    assert math.isnan(metrics(spark, [(0.0, 1.0)]).mape)


def test_train_select_save_and_score(spark, records, tmp_path):
    result = train.train(records, train.build_estimators(trees=5, rounds=4, extra_rounds=4, depth=4))
    board = result.leaderboard.collect()
    assert {r.model for r in board} == {"linear_regression", "random_forest", "gradient_boosting", "subsampled_boosting"}
    assert board[0].model == result.best and board[0].r2 == max(r.r2 for r in board)
    document = train.leaderboard_document(result).filter("selected").collect()
    assert len(document) == 1 and document[0].test_r2 is not None
    train.save_model(result, str(tmp_path / "model"))
    loaded = train.load_model(str(tmp_path / "model"))
    before = score.score(result.best_pipeline(), records).orderBy("record_id").collect()
    after = score.score(loaded, records).orderBy("record_id").collect()
    assert before == after and len(after) == 200
    assert all(r.predicted_yield >= 0 and round(r.predicted_yield, 4) == r.predicted_yield for r in after)
    files.write_metrics_json(train.leaderboard_document(result), str(tmp_path / "board"))
    assert spark.read.json(str(tmp_path / "board")).count() == 4


def test_request_validation(spark, records):
    base = records.limit(1)
    cases = {
        "": base,
        "crop_type": base.withColumn("crop_type", F.lit("Banana")),
        "humidity_percent": base.withColumn("humidity_percent", F.lit(150.0)),
        "soil_pH": base.withColumn("soil_pH", F.lit(None).cast("double")),
        "co2_ppm,days_to_maturity": base.withColumns({"days_to_maturity": F.lit(0), "co2_ppm": F.lit(-1.0)}),
    }
    for expected, frame in cases.items():
        row = score.validate_requests(frame).first()
        assert ",".join(row.failures) == expected and row.accepted == (expected == "")


def test_zone_inputs_treat_zero_as_missing(spark):
    columns = ["zone_id int", "crop_type string"] + [
        f"{kind}_{name} {t}"
        for kind in ("temperature", "humidity", "soil_moisture", "co2", "light")
        for name, t in (("sensor_id", "int"), ("value", "double"))
    ]
    rows = [
        (1, "tomato", 1, 0.0, 2, None, 3, 50.0, None, None, 5, 0.0),
        (2, "PEPPER", 1, 20.0, 2, 65.0, 3, None, 4, 900.0, 5, 15000.0),
        (3, "tomato", 1, None, 2, 65.0, 3, 50.0, 4, 900.0, 5, 1.0),
        (4, "tomato", 1, 20.0, None, None, 3, 50.0, 4, 900.0, 5, 1.0),
        (5, "tomato", 1, 55.0, 2, 65.0, 3, 50.0, 4, 900.0, 5, 1.0),
        (6, "kale", 1, 20.0, 2, 65.0, 3, 50.0, 4, 900.0, 5, 1.0),
    ]
    found = {r.zone_id: r for r in score.zone_yield_inputs(spark.createDataFrame(rows, ", ".join(columns))).collect()}
    assert set(found) == {1, 2}
    assert (found[1].avg_temperature_C, found[1].humidity_percent, found[1].co2_ppm, found[1].light_intensity_lux) == (22.0, 70.0, 800.0, 20000.0)
    assert (found[2].crop_type, found[2].min_temperature_C, found[2].max_temperature_C) == ("Pepper", 15.0, 25.0)


def test_fingerprint_depends_on_rows_not_order(records):
    one = train.dataset_fingerprint(records).first()
    assert train.dataset_fingerprint(records.repartition(7).sort("co2_ppm")).first() == one
    assert len(one.fingerprint) == 16 and one.row_count == 200
    assert train.dataset_fingerprint(records.filter("record_id > 0")).first().fingerprint != one.fingerprint
    changed = records.withColumn("co2_ppm", F.when(F.col("record_id") == 0, 1.0).otherwise(F.col("co2_ppm")))
    assert train.dataset_fingerprint(changed).first().fingerprint != one.fingerprint


def test_csv_round_trip(spark, records, tmp_path):
    files.write_csv(records.withColumn("variety", F.lit("x")), str(tmp_path / "csv"))
    again = files.read_yield_csv(spark, str(tmp_path / "csv"))
    assert again.schema == schemas.YIELD_RECORDS
    assert again.exceptAll(records.drop("record_id")).count() == 0 and again.count() == 200


def test_an_undefined_r2_ranks_last_and_an_empty_split_is_an_error(records):
    flat = records.withColumn(features.TARGET, F.lit(2.0))
    linear = {"linear_regression": train.build_estimators()["linear_regression"]}
    assert train.train(flat, linear).best == "linear_regression"
    with pytest.raises(ValueError, match="split has no rows"):
        train.train(records.limit(1), linear)


def test_fit_rows_bound_the_fit_alone(records):
    linear = {"linear_regression": train.build_estimators()["linear_regression"]}
    few, all_rows = train.train(records, linear, fit_rows=60), train.train(records, linear)
    assert few.leaderboard.first().row_count == all_rows.leaderboard.first().row_count
    assert few.leaderboard.first().rmse != all_rows.leaderboard.first().rmse


def test_a_crop_with_an_apostrophe_is_imputed_as_itself(records):
    named = records.withColumn("crop_type", F.when(F.col("record_id") % 5 > 0, F.lit("Baker's")))
    model = features.build_preprocessor(named).fit(named)
    assert {r.crop for r in model.transform(named).select("crop").distinct().collect()} == {"Baker's"}


def test_products_are_added_in_tasks_and_not_by_wide_aggregates(records, capsys):
    names = [*features.NUMERIC, features.TARGET]
    found = linear.moments(records, names)
    found.explain()
    assert "avg(" not in capsys.readouterr().out
    rows = records.select(*names).dropna().toPandas().astype(float)
    pairs = {(r["first"], r["second"]): r.mean_product for r in found.collect()}
    assert len(pairs) == len(names) * (len(names) + 1) // 2
    assert all(mean == pytest.approx((rows[a] * rows[b]).mean(), rel=1e-12) for (a, b), mean in pairs.items())
    assert {r.mean_product for r in linear.moments(records.limit(0), names).collect()} == {None}
    gaps = records.withColumn("co2_ppm", F.expr("CASE WHEN record_id % 5 = 0 THEN NULL WHEN record_id % 7 = 0 THEN double('NaN') ELSE co2_ppm END"))
    some = linear.moments(gaps, names).filter("first = 'co2_ppm' AND second = 'co2_ppm'").first().mean_product
    whole = records.filter("record_id % 5 > 0 AND record_id % 7 > 0").dropna().toPandas().co2_ppm
    assert some == pytest.approx((whole**2).mean(), rel=1e-12)


def test_a_stored_place_gives_the_same_split(records):
    plain = {r.record_id: r.split for r in split.assign_split(records).collect()}
    placed = records.withColumn("at", split.place_of("record_id"))
    assert {r.record_id: r.split for r in split.assign_split(placed, place=F.col("at")).collect()} == plain


def test_a_forest_is_fitted_by_portions_of_its_trees(records, monkeypatch, tmp_path):
    """No fit and no task holds all the trees; the model is the mean of all of them."""
    monkeypatch.setattr(train, "TREES_AT_ONCE", 2)
    forest = {"random_forest": train.build_estimators(trees=5, depth=4)["random_forest"]}
    result = train.train(records, forest)
    portions = result.fitted["random_forest"].stages[:-1]
    assert sorted(p.getNumTrees for p in portions) == [1, 2, 2]
    assert {(p.getMaxDepth(), p.getMinInstancesPerNode(), p.getFeatureSubsetStrategy()) for p in portions} == {(4, 3, "onethird")}
    assert len({p.getSeed() for p in portions}) == 3
    prepared = result.preprocessor.transform(records)
    found = {r.record_id: r for r in result.best_pipeline().transform(records).collect()}
    assert not any(c.startswith("portion_") for c in next(iter(found.values())).asDict())
    for row in prepared.limit(20).collect():
        each = [tree.predict(row.features) for p in portions for tree in p.trees]
        assert found[row.record_id].prediction == pytest.approx(sum(each) / 5, abs=1e-12)
    train.save_model(result, str(tmp_path / "forest"))
    again = score.score(train.load_model(str(tmp_path / "forest")), records).collect()
    assert sorted(again) == sorted(score.score(result.best_pipeline(), records).collect()) and len(again) == 200
