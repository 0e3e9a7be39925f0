"""Candidate estimators, the leaderboard and the selected model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sensorloom.operators.yields.evaluate import regression_metrics
from sensorloom.operators.yields.features import TARGET, build_preprocessor
from sensorloom.operators.yields.split import SEED, assign_split


# Boosting takes a thousand passes over the training rows: few tasks each while they are few.
ROWS_PER_TASK = 2_500
# A forest sums up a table for each open node in each task: fewer tasks, and few trees at a time,
# since the nodes of all trees that are being grown are in the driver.
FOREST_ROWS_PER_TASK = 10_000
TREES_AT_ONCE = 5
# Fits that run side by side; most of their passes are too short to fill a cluster.
FITS_AT_ONCE = 6


def build_estimators(trees: int = 200, rounds: int = 200, extra_rounds: int = 300, depth: int = 15) -> dict[str, Estimator]:
    """The candidates at full size by default; smaller numbers give quick runs."""
    # The published sizes, learning rates and shares.
    common = {"labelCol": TARGET, "featuresCol": "features", "predictionCol": "prediction"}
    return {
        "linear_regression": LinearRegression(regParam=0.0, **common),
        "random_forest": RandomForestRegressor(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=3, maxMemoryInMB=64, seed=SEED, **common
        ),
        "gradient_boosting": GBTRegressor(maxIter=rounds, maxDepth=min(5, depth), stepSize=0.05, seed=SEED, **common),
        "subsampled_boosting": GBTRegressor(
            maxIter=extra_rounds, maxDepth=min(6, depth), stepSize=0.05, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", seed=SEED, **common
        ),
    }


@dataclass(frozen=True)
class TrainedModels:
    preprocessor: PipelineModel
    fitted: Mapping[str, PipelineModel]
    leaderboard: DataFrame  # model, mae, rmse, r2, mape, row_count: validation, best first
    best: str
    test_metrics: DataFrame

    def best_pipeline(self) -> PipelineModel:
        return PipelineModel(stages=[self.preprocessor, self.fitted[self.best]])


def train(
    records: DataFrame,
    estimators: Mapping[str, Estimator] | None = None,
    key: str = "record_id",
    fit_rows: int | None = None,
) -> TrainedModels:
    """Fit every candidate on the training split; the best validation R2, then RMSE, wins.

    Estimators are fitted on every row of the training split. ``fit_rows`` bounds them for
    quick runs, to about that many by the hash of their key; preprocessing, validation and
    test metrics use every row of their split all the same. A candidate whose R2 is not
    defined ranks last.

    The preprocessor only sees training rows. The records are read by each of its passes and
    kept in memory, with disk behind it, until the prepared rows are; these stay for the run,
    each row once. The estimators are fitted side by side, a forest by portions of its trees.
    """
    estimators = estimators or build_estimators()
    parts = assign_split(records.filter(F.col(TARGET).isNotNull()), key).persist(StorageLevel.MEMORY_AND_DISK)
    fitting = held_out = None
    try:
        sizes = dict(parts.groupBy("split").count().collect())
        for name in ("train", "validation", "test"):
            if not sizes.get(name):
                raise ValueError(f"the {name} split has no rows")
        preprocessor = fit_preprocessor(parts)
        prepared = preprocessor.transform(parts).select(key, "split", "features", TARGET)
        held_out = prepared.filter("split <> 'train'").persist(StorageLevel.MEMORY_AND_DISK)
        rows = {name: held_out.filter(F.col("split") == name) for name in ("validation", "test")}
        fitting, kept = prepared.filter("split = 'train'"), sizes["train"]
        if fit_rows is not None and kept > fit_rows:
            chance = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1_000_000)) * kept
            fitting, kept = fitting.filter(chance < fit_rows * 1_000_000), fit_rows
        fitting = fitting.coalesce(-(-kept // ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
        for frame in (fitting, held_out):
            frame.count()
        parts.unpersist()
        fitted = fit_all(estimators, fitting, kept)
        scored = [
            model.transform(rows["validation"]).select(F.lit(name).alias("model"), TARGET, "prediction")
            for name, model in fitted.items()
        ]
        metrics = regression_metrics(reduce(DataFrame.unionByName, scored), TARGET, "prediction", "model").collect()
        spark = records.sparkSession
        # one row per candidate
        ranked = sorted(metrics, key=lambda m: (m["r2"] is None, -(m["r2"] or 0.0), m["rmse"]))
        best = ranked[0]["model"]
        test = regression_metrics(fitted[best].transform(rows["test"]), TARGET, "prediction").collect()
        return TrainedModels(
            preprocessor, fitted, _frame(spark, ranked), best, _frame(spark, test)
        )
    finally:
        if fitting is not None:
            fitting.unpersist()
        parts.unpersist()
        if held_out is not None:
            held_out.unpersist()


def forest_portions(forest: RandomForestRegressor) -> list[RandomForestRegressor]:
    """Forests of at most TREES_AT_ONCE trees each that have the trees of this one together."""
    trees, seed = forest.getNumTrees(), forest.getSeed()
    chosen = forest.getFeatureSubsetStrategy()
    share = "onethird" if chosen == "auto" else chosen  # as auto is for several trees, also in a portion of one
    number = -(-trees // TREES_AT_ONCE)
    sizes = [trees * (i + 1) // number - trees * i // number for i in range(number)]
    return [
        forest.copy({
            forest.numTrees: size, forest.seed: seed + i, forest.featureSubsetStrategy: share,
            forest.predictionCol: f"portion_{i}",
        })
        for i, size in enumerate(sizes)
    ]


def joined_forest(portions: list, prediction: str) -> PipelineModel:
    """One model of the portions' trees: the mean of all trees is that of the portions by their trees."""
    names = [model.getPredictionCol() for model in portions]
    total = " + ".join(f"{model.getNumTrees}D * {name}" for model, name in zip(portions, names))
    trees = sum(model.getNumTrees for model in portions)
    mean = f"SELECT * EXCEPT ({', '.join(names)}), ({total}) / {trees}D AS {prediction} FROM __THIS__"
    return PipelineModel(stages=[*portions, SQLTransformer(statement=mean)])


def fit_all(estimators: Mapping[str, Estimator], rows: DataFrame, count: int) -> dict[str, PipelineModel]:
    """Fit the estimators on the rows, FITS_AT_ONCE side by side, forests by portions of their trees."""
    few_tasks = rows.coalesce(-(-count // FOREST_ROWS_PER_TASK))
    fits = []
    for name, estimator in estimators.items():
        if isinstance(estimator, RandomForestRegressor) and estimator.getNumTrees() > TREES_AT_ONCE:
            fits += [(name, portion, few_tasks) for portion in forest_portions(estimator)]
        else:
            fits.append((name, estimator, rows))
    # boosting is one long chain of passes: it starts first
    fits.sort(key=lambda fit: -fit[1].getMaxIter() if isinstance(fit[1], GBTRegressor) else 0)
    with ThreadPool(FITS_AT_ONCE) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(lambda fit: fit[1].fit(fit[2])), fits, chunksize=1)
    by_name: dict[str, list] = {name: [] for name in estimators}
    for (name, _, _), model in zip(fits, models):
        by_name[name].append(model)
    return {
        name: joined_forest(found, estimators[name].getPredictionCol()) if len(found) > 1 else PipelineModel(stages=found)
        for name, found in by_name.items()
    }


def fit_preprocessor(parts: DataFrame) -> PipelineModel:
    """Fit the preprocessing stages on the training rows of a split frame."""
    training = parts.filter("split = 'train'")
    return build_preprocessor(training).fit(training)


def _frame(spark: SparkSession, rows: list) -> DataFrame:
    names = list(rows[0].asDict())
    kinds = {"model": "string", "row_count": "long"}
    schema = ", ".join(f"{name} {kinds.get(name, 'double')}" for name in names)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def leaderboard_document(result: TrainedModels) -> DataFrame:
    """Validation metrics of every model and, for the winner, the held-out test metrics."""
    test = result.test_metrics.select(
        F.lit(result.best).alias("model"), *[F.col(c).alias(f"test_{c}") for c in ("mae", "rmse", "r2", "mape")]
    )
    return result.leaderboard.join(test, "model", "left").withColumn("selected", F.col("model") == result.best)


def save_model(result: TrainedModels, path: str) -> None:
    result.best_pipeline().write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


_PRIME = (1 << 61) - 1


def _exact_text(name: str, kind: str) -> str:
    """A value as text that any engine writes alike; a double in two whole numbers that hold all its bits.

    Doubles are exact below 2**42 in size and down to multiples of 2**-72.
    """
    if kind != "double":
        return f"coalesce(CAST(`{name}` AS STRING), chr(30))"
    scaled = f"(`{name}` * 1048576D)"
    whole = f"floor({scaled})"
    part = f"floor(({scaled} - {whole}) * 4503599627370496D)"
    return f"coalesce(concat(CAST({whole} AS STRING), '.', CAST({part} AS STRING)), chr(30))"


def dataset_fingerprint(records: DataFrame) -> DataFrame:
    """Sixteen hex digits that change when any row does, in one pass and in any row order.

    A multiset hash: two 52-bit pieces of each row's md5 are summed modulo a prime, so repeated
    rows count and partial sums merge in any order.
    """
    text = F.expr("concat_ws(chr(31), " + ", ".join(_exact_text(name, kind) for name, kind in records.dtypes) + ")")
    digest = records.select(F.md5(text).alias("d"))
    pieces = [F.conv(F.substring("d", at, 13), 16, 10).cast("decimal(38,0)") for at in (1, 14)]
    sums = digest.agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(pieces)), F.count(F.lit(1)).alias("row_count"))
    rests = [F.expr(f"CAST(s{i} % {_PRIME} AS STRING)") for i in (0, 1)]
    return sums.select(
        F.substring(F.md5(F.concat_ws(":", *rests, F.col("row_count").cast("string"))), 1, 16).alias("fingerprint"), "row_count"
    )
