"""What the operators of this subpackage share: inputs, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorloom.sources.shared import shared_folder, written  # noqa: F401

_BITS = 1 << 23
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def learning_fold(doc_id: Column) -> Column:
    """True where a document may be learnt from: crc32 of its id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(~learning_fold(doc_id), F.lit(False))


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """Apply a function to each Arrow batch; it yields any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield from function(batch)
        finally:
            give_back()

    return small_batches(frame).mapInArrow(run, schema)


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, of whose rows a task gets BATCH_BYTES at a time, or one row where that is larger.

    Spark's own bound is 64 MB, which executor and worker each hold more than once. A session
    in which the bound is set keeps its own.
    """
    spark = frame.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return frame


def give_back() -> None:
    """Return what Arrow holds unused, so that a worker between tasks does not keep a task's peak."""
    pa.default_memory_pool().release_unused()


def marked(frame: DataFrame, key: Column, wanted: DataFrame, mark: str) -> DataFrame:
    """The frame with a column `mark`: false only where the key is not among the wanted ones.

    The wanted keys, one long column, are folded into a bitmap of 2**23 bits, a megabyte in all
    whatever their number, which is broadcast; a shuffle of the frame can then leave out most
    rows that a join would drop. Keys may share a bit, so a join must follow. With many more
    wanted keys than bits every row is marked, and only the saving is lost.
    """
    place = F.pmod(key, F.lit(_BITS))
    place_wanted = F.pmod(F.col(wanted.columns[0]), F.lit(_BITS))
    bits = wanted.groupBy(F.bitmap_bucket_number(place_wanted).alias("__llm_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place_wanted)).alias("__llm_bits")
    )
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__llm_bits", (position / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    found = F.expr("shiftright(__llm_byte, __llm_bit) & 1") == 1
    return (
        frame.withColumn("__llm_at", F.bitmap_bucket_number(place))
        .join(F.broadcast(bits), F.col("__llm_at") == F.col("__llm_bucket"), "left")
        .withColumns({"__llm_byte": byte, "__llm_bit": (position % 8).cast("int")})
        .withColumn(mark, F.coalesce(found, F.lit(False)))
        .drop("__llm_at", "__llm_bucket", "__llm_bits", "__llm_byte", "__llm_bit")
    )


def smallest_hashes(ids: DataFrame, count: int) -> DataFrame:
    """The `count` distinct doc_ids with the smallest hashes, all where there are fewer.

    The number of distinct ids is estimated first; only ids below twice the share that is
    needed are made distinct, so that the ids of a large table are not shuffled.
    """
    value = F.xxhash64("doc_id")
    known = ids.agg(F.approx_count_distinct("doc_id")).first()[0]
    if known > 2 * count:
        ids = ids.where(value < F.lit(int(2.0**64 * 2 * count / known) - (1 << 63)))
    return ids.distinct().orderBy(value, "doc_id").limit(count)


def one_text(sample: DataFrame, *marks: str) -> DataFrame:
    """One row for each doc_id with its smallest text, so that a bound on ids is one on rows."""
    return sample.groupBy("doc_id", *marks).agg(F.min("text").alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that repeat an id with another text; goes with doc_id in joins."""
    return F.xxhash64(doc_id, text)
