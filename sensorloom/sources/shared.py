"""The folder that driver and executors share, and frames stored in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir.

    Where the setting is absent: the context's checkpoint directory, else a temporary folder if
    driver and executors are one process, else a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif context.master.partition("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="checkpoint-")
            context.setCheckpointDir(root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    # one slash or three, the same folder; file systems outside Spark want three
    root = re.sub("^file:/+", "file:///", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: its lineage ends there.

    What is returned reads the files whenever it is used, so they stay; cleaning the folder
    between runs is the cluster's part, as with checkpoints.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark, purpose)
    schema = frame.schema
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
