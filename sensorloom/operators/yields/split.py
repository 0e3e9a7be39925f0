"""Reproducible train / validation / test split, exact in every stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.selection import order_statistics

SEED = 42


def held_out_rows(rows: int) -> int:
    """Rows of a stratum for validation, and as many for the test: 15 in a hundred, half up."""
    return (15 * rows + 50) // 100


def place_of(key: str, seed: int = SEED) -> Column:
    """52 bits of the digest of the record key, exact as a double."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


_place = place_of


def assign_split(
    records: DataFrame, key: str = "record_id", seed: int = SEED, by: str = "crop_type", place: Column | None = None
) -> DataFrame:
    """Add ``split``: of each stratum exactly 15 % validation, 15 % test (half up) and the rest training.

    Records are ordered by the digest of their key; two thresholds for each stratum, found by
    distributed selection, cut that order, so rows are neither shuffled nor sorted. Strata are
    few, one row each comes to the driver; null is a stratum. Rows that share a key stay together.
    Records are read once a round and once for the result; where they hold ``place_of(key, seed)``
    already, ``place`` is that column and no digest is made again.
    """
    place = _place(key, seed) if place is None else place
    placed = records.select(F.col(by).alias("group"), place.alias("value"), F.col(key).alias("key"))

    def last_ranks(rows: int) -> list[int]:
        held = held_out_rows(rows)
        return [rows - 2 * held - 1, rows - held - 1]

    found = order_statistics(placed, last_ranks)
    kind, key_kind = (placed.schema[c].dataType.simpleString() for c in ("group", "key"))
    cuts = []
    for group, ranks in found.items():
        ordered = [ranks[rank] for rank in sorted(ranks)]
        cuts.append((group, ordered[0].value, min(ranks) - ordered[0].less, ordered[-1].value, max(ranks) - ordered[-1].less))
    spark = records.sparkSession
    schema = f"__group {kind}, __v1 double, __n1 long, __v2 double, __n2 long"
    bounds = F.broadcast(spark.createDataFrame(cuts, schema))
    # digests that collide at a threshold: the smaller keys come first; a handful of rows
    at = placed.join(bounds, F.col("group").eqNullSafe(F.col("__group")) & ((F.col("value") == F.col("__v1")) | (F.col("value") == F.col("__v2"))))
    tied: dict = {}
    for row in at.groupBy("group", "value", "key").count().collect():
        tied.setdefault((row.group, row.value), []).append((row.key, row["count"]))

    def last_key(group, value, rank):
        for name, count in sorted(tied[group, value]):
            if rank < count:
                return name
            rank -= count

    keyed = [(g, v1, last_key(g, v1, n1), v2, last_key(g, v2, n2)) for g, v1, n1, v2, n2 in cuts]
    bounds = spark.createDataFrame(keyed, f"__group {kind}, __v1 double, __k1 {key_kind}, __v2 double, __k2 {key_kind}")
    at = F.struct(F.col("__place"), F.col(key))
    name = F.when(at <= F.struct("__v1", "__k1"), "train").when(at <= F.struct("__v2", "__k2"), "validation").otherwise("test")
    return (
        records.withColumn("__place", place)
        .join(F.broadcast(bounds), F.col(by).eqNullSafe(F.col("__group")), "left")
        .withColumn("split", name)
        .select(*(F.col(f"`{c}`") for c in records.columns if c != "split"), "split")
    )
