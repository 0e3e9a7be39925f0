import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import frames


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key.rpartition(".")[2], default)


@pytest.mark.parametrize("root", ["file:/shared", "file:///shared/", "hdfs://name/shared", "/shared"])
def test_the_setting_names_the_folder(root):
    session = type("Session", (), {"conf": Conf(dir=root)})
    folder = frames.shared_folder(session, "x")
    assert folder.startswith(root.replace("file:/s", "file:///s").rstrip("/") + "/x-")
    assert folder != frames.shared_folder(session, "x")


def test_marks_lose_no_wanted_row(spark):
    rows = spark.range(-3_000, 3_000).select(F.xxhash64("id").alias("key"), "id", F.lit(1).alias("held"))
    wanted = rows.where("id % 7 = 0").select("key")
    marked = frames.marked(rows.drop("held"), F.col("key"), wanted, "held")
    found = {r.id: r.held for r in marked.collect()}
    assert len(found) == 6_000
    assert all(found[i] for i in range(-2_996, 3_000, 7) if i % 7 == 0)
    assert sum(found.values()) < 900
    none = frames.marked(rows.drop("held"), F.col("key"), wanted.limit(0), "held")
    assert none.where("held").count() == 0


def test_folds(spark):
    import zlib

    ids = spark.range(40).select("id", frames.held_out(F.col("id")).alias("held"))
    assert {r.id: r.held for r in ids.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40)}


def _sizes(batch):
    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def test_a_task_gets_a_bounded_number_of_bytes_at_a_time(spark):
    long = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    found = frames.map_batches(long, _sizes, "n long, size long").collect()
    assert sum(row.n for row in found) == 2_000
    assert max(row.size for row in found) < 2 * frames.BATCH_BYTES
    short = frames.map_batches(spark.range(0, 30_000, 1, 1), _sizes, "n long, size long").collect()
    assert sum(row.n for row in short) == 30_000


def test_a_bound_that_the_session_has_stays(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "1m")
    try:
        frames.small_batches(spark.range(1))
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
