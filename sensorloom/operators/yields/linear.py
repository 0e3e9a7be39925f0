"""Least squares in one pass: the sums of products are one aggregate, the solve is small."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANK_TOLERANCE = 1e-10  # of the greatest eigenvalue: directions below are no directions


def moments(frame: DataFrame, columns: list[str]) -> DataFrame:
    """first, second and mean of the product of each pair of columns, over rows without nulls or NaN.

    Each task adds up the products of its batches as matrices and gives one row for each of the
    p * (p + 1) / 2 pairs; only these are shuffled, and the rows are read once. Tasks leave out the
    rows with nulls: as a filter on computed columns, Spark would plan and compute those twice.
    """
    columns = list(columns)
    width = len(columns)
    first, second = np.triu_indices(width)
    whole = frame.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((width, width)), 0
        for batch in batches:
            block = np.array([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            block = block[:, ~np.isnan(block).any(axis=0)]  # nulls are NaN here
            with np.errstate(invalid="ignore", over="ignore"):
                total += block @ block.T
            rows += block.shape[1]
        if rows:
            values = [pa.array(np.arange(len(first), dtype=np.int32)), pa.array(total[first, second]), pa.array(np.full(len(first), rows))]
            yield pa.RecordBatch.from_arrays(values, names=["pair", "total", "rows"])

    parts = whole.mapInArrow(products, "pair int, total double, rows long")
    means = parts.groupBy("pair").agg((F.sum("total") / F.sum("rows")).alias("mean_product"))
    names = [(i, columns[a], columns[b]) for i, (a, b) in enumerate(zip(first.tolist(), second.tolist()))]
    pairs = frame.sparkSession.createDataFrame(names, "pair int, first string, second string")
    return pairs.join(F.broadcast(means), "pair", "left").select("first", "second", "mean_product")


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coefficients: dict[str, float]

    def predict(self) -> Column:
        """The prediction as an expression over the feature columns."""
        total = F.lit(self.intercept)
        for name, weight in self.coefficients.items():
            total = total + F.lit(weight) * F.col(f"`{name}`")
        return total


def fit(frame: DataFrame, label: str, features: list[str]) -> LinearModel:
    """The least-squares fit with an intercept; of several, as with collinear features, the shortest.

    The intercept is a column of ones. p * p numbers reach the driver, whatever the rows.
    """
    names = [*features, label]
    one = "__one"
    rows = moments(frame.withColumn(one, F.lit(1.0)), [one, *names]).collect()
    place = {name: i for i, name in enumerate([one, *names])}
    matrix = np.zeros((len(place), len(place)))
    for a, b, mean in rows:
        if mean is None:
            raise ValueError("no rows to fit")
        matrix[place[a], place[b]] = matrix[place[b], place[a]] = mean
    # centred, so that the length minimised is that of the coefficients alone
    means = matrix[0, 1:]
    centred = matrix[1:, 1:] - np.outer(means, means)
    weights = np.linalg.pinv(centred[:-1, :-1], rcond=_RANK_TOLERANCE, hermitian=True) @ centred[:-1, -1]
    return LinearModel(float(means[-1] - means[:-1] @ weights), dict(zip(features, weights.tolist())))
