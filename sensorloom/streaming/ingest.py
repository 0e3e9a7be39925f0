"""Continuous, idempotent ingestion of JSON readings into a date-partitioned table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators import ingestion
from sensorloom.sources.files import write_table

STORED = f"sensor_id int, timestamp timestamp, value {ingestion.STORED_VALUE}, reading_date date, ingest_batch long"
PARTITIONS = ("reading_date", "ingest_batch")


@dataclass(frozen=True)
class IngestPaths:
    root: str

    @property
    def readings(self) -> str:
        return f"{self.root}/readings"

    @property
    def refused(self) -> str:
        return f"{self.root}/refused"

    @property
    def stats(self) -> str:
        return f"{self.root}/stats"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoints/ingest"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def stored_readings(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    return read_or_empty(spark, paths.readings, STORED)


def document_stream(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """One JSON reading per line of the files that arrive in a directory."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory)
    return lines.select(F.col("value").alias("raw"))


def deduplicated(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats that arrive within the watermark, for sinks that keep no key history."""
    return readings.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["sensor_id", "timestamp"])


def ingest_batch(documents: DataFrame, batch_id: int, sensors: DataFrame, paths: IngestPaths) -> None:
    """Store the new readings of one micro-batch with its refused rows and counts.

    Refused are malformed readings and those of unknown sensors, each with its problem.
    All three outputs are keyed by the batch and replace themselves, and the stored keys
    compared with exclude this batch, so a batch that is run again after a failure leaves
    the same rows and the same counts.
    """
    spark = documents.sparkSession
    parsed = ingestion.parse_readings(documents.withColumn("seq", F.monotonically_increasing_id())).persist()
    try:
        batch = ingestion.accepted(parsed)
        stored = stored_readings(spark, paths).filter(F.col("ingest_batch") < batch_id)
        stats = ingestion.ingest_stats(batch, sensors, stored)
        fresh = ingestion.insertable(batch, sensors, stored).drop("seq")
        labelled = fresh.withColumn("ingest_batch", F.lit(batch_id).cast("long"))
        write_table(labelled, paths.readings, PARTITIONS, ("sensor_id", "timestamp"), replace="partitions")
        stats.write.mode("overwrite").parquet(f"{paths.stats}/batch={batch_id}")
        refused = ingestion.malformed(parsed).unionByName(ingestion.unknown_sensors(parsed, sensors))
        refused = refused.select("raw", "problem")
        refused.write.mode("overwrite").parquet(f"{paths.refused}/batch={batch_id}")
    finally:
        parsed.unpersist()


def start_ingest(documents: DataFrame, sensors: DataFrame, paths: IngestPaths, **trigger) -> StreamingQuery:
    """Run ``ingest_batch`` on every micro-batch; trigger arguments as for ``writeStream``."""
    return (
        documents.writeStream.queryName("ingest")
        .option("checkpointLocation", paths.checkpoint)
        .foreachBatch(lambda frame, batch_id: ingest_batch(frame, batch_id, sensors, paths))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
