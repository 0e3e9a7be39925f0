"""Tables in files: typed CSV, JSON metrics, partitioned Parquet, temporary views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sensorloom.schemas import YIELD_RECORDS


def read_yield_csv(spark: SparkSession, path: str) -> DataFrame:
    """Yield records by column name; other columns of the file are ignored."""
    header = spark.read.option("header", True).csv(path)
    return header.select(*[F.col(f.name).cast(f.dataType) for f in YIELD_RECORDS.fields])


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_table(
    frame: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    replace: str = "table",
) -> int:
    """Write a Parquet table and return its row count, observed while writing.

    ``replace`` is ``table`` for a full refresh or ``partitions`` to replace only the
    partitions that occur in the frame, which also makes a repeated write harmless.
    Rows are rebalanced by the partition columns: adaptive execution merges small dates
    into one task and splits a busy one over several, by measured size. They are sorted so
    that readers can skip row groups.
    """
    mode = {"table": "static", "partitions": "dynamic"}[replace]
    seen = Observation()
    rows = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition_by:
        rows = rows.hint("rebalance", *[F.col(name) for name in partition_by])
    if partition_by or sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return int(seen.get["rows"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_views(frames: Mapping[str, DataFrame], columns: Mapping[str, tuple[str, ...]] | None = None) -> None:
    """Expose frames as temporary views, each restricted to its listed columns."""
    for name, frame in frames.items():
        chosen = (columns or {}).get(name)
        (frame.select(*chosen) if chosen else frame).createOrReplaceTempView(name)
