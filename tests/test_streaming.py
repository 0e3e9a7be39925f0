import json
from datetime import timedelta, timezone

from pyspark.sql import functions as F

from sensorloom import schemas
from sensorloom.operators import alerts as alert_ops
from sensorloom.operators import rollups
from sensorloom.sources.snapshots import SnapshotStore
from sensorloom.streaming import ingest, lifecycle, views
from tests.conftest import DAY, NOON, hours, minutes


def write_lines(path, name, rows):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"sensor_id": s, "timestamp": t.isoformat(), "value": v}) for s, t, v in rows]
    (path / name).write_text("\n".join(lines) + "\n")


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def stats(spark, paths):
    return {r.batch: (r.received, r.inserted, r.rejected, r.duplicates) for r in spark.read.parquet(paths.stats).collect()}


def test_ingestion_is_idempotent(spark, fleet, tmp_path):
    source, paths = tmp_path / "in", ingest.IngestPaths(str(tmp_path / "lake"))
    sensors = fleet.sensors((1, 1, "temperature"), (2, 1, "humidity"))
    rows = [(1, minutes(i), 20.0 + i) for i in range(6)] + [(9, NOON, 1.0), (1, minutes(0), 99.0)]
    write_lines(source, "a.json", rows)
    with open(source / "a.json", "a") as file:
        file.write('{"sensor_id": 1}\n')
    stream = ingest.document_stream(spark, str(source), 1)
    drain(ingest.start_ingest(stream, sensors, paths))
    assert stats(spark, paths) == {0: (8, 6, 1, 1)}
    write_lines(source, "b.json", rows[:3] + [(2, NOON, 50.0)])
    drain(ingest.start_ingest(stream, sensors, paths))
    assert stats(spark, paths)[1] == (4, 1, 0, 3)
    stored = ingest.stored_readings(spark, paths)
    assert stored.count() == 7
    assert stored.filter(F.col("value") == 99.0).count() == 0
    assert {r.problem for r in spark.read.parquet(paths.refused).collect()} == {"timestamp", "unknown sensor"}
    assert spark.read.parquet(paths.refused).count() == 2
    # a batch that runs again after a failure replaces what it wrote
    again = spark.read.text(str(source / "b.json")).select(F.col("value").alias("raw"))
    ingest.ingest_batch(again, 1, sensors, paths)
    assert stats(spark, paths)[1] == (4, 1, 0, 3)
    assert ingest.stored_readings(spark, paths).count() == 7


def as_stream(spark, tmp_path, frame, schema, files=3):
    path = str(tmp_path / "table")
    frame.repartition(files).write.parquet(path)
    return views.table_stream(spark, path, schema, 1)


def run_to_memory(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    drain(query)


def test_repeats_inside_the_watermark_are_dropped(spark, tmp_path):
    path, schema = str(tmp_path / "readings"), "sensor_id int, timestamp timestamp, value double"
    for rows in ([(1, NOON, 1.0), (1, NOON, 2.0)], [(1, NOON, 3.0), (2, NOON, 4.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    run_to_memory(ingest.deduplicated(views.table_stream(spark, path, schema, 1)), "once", "append")
    assert sorted(r.sensor_id for r in spark.table("once").collect()) == [1, 2]


def test_late_rows_never_replace_newer_ones(spark, fleet, tmp_path):
    path = str(tmp_path / "readings")
    schema = "sensor_id int, timestamp timestamp, value double"
    frames = [[(1, NOON, 3.0), (2, hours(1), 1.0)], [(1, hours(2), 9.0), (2, NOON, 2.0)], [(3, NOON + timedelta(days=2), 7.0)]]
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    run_to_memory(views.latest_values(views.table_stream(spark, path, schema, 1)), "latest", "complete")
    assert {r.sensor_id: r.value for r in spark.table("latest").collect()} == {1: 3.0, 2: 2.0, 3: 7.0}


def settled_hours(frame):
    """Rows as a set; the deviation's last digits depend on the order of merging."""
    return {tuple(r) for r in frame.withColumn("std_value", F.round("std_value", 9)).collect()}


def test_streamed_hours_equal_the_batch_rollup(spark, fleet, tmp_path):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 2, "humidity"))
    kinds = {1: "temperature", 2: "humidity"}
    rows = [
        (i, s, kinds[s], DAY + timedelta(minutes=17 * i + s), float(i % 13), i % 29 == 0)
        for i in range(200) for s in (1, 2)
    ]
    clean = spark.createDataFrame(rows, schemas.CLEAN_READINGS)
    expected = settled_hours(rollups.hourly_rollup(clean, sensors))
    path = str(tmp_path / "clean")
    for day in range(3):
        low, high = DAY + timedelta(days=day), DAY + timedelta(days=day + 1)
        clean.filter((F.col("timestamp") >= low) & (F.col("timestamp") < high)).coalesce(1).write.mode("append").parquet(path)
    stream = views.table_stream(spark, path, "id long, sensor_id int, sensor_type string, timestamp timestamp, value double, is_outlier boolean", 1)
    run_to_memory(views.hourly_stream(stream, sensors, "1 day"), "hours", "append")
    found = settled_hours(spark.table("hours"))
    newest = max(r[3] for r in rows)
    closed = {r for r in expected if r[2].astimezone(timezone.utc) + timedelta(hours=1) <= newest - timedelta(days=1)}
    assert found == closed and len(found) > 20


def test_alerts_and_recommendations_follow_the_stream(spark, fleet, tmp_path):
    root = str(tmp_path)
    sensors, zones = fleet.sensors((1, 1, "temperature"), (2, 1, "soil_moisture"), (3, 2, "soil_moisture")), fleet.zones(1, 2)
    schema = "sensor_id int, timestamp timestamp, value double, reading_date date"
    path = f"{root}/readings"

    def arrive(*rows):
        frame = spark.createDataFrame([(*r, r[1].date()) for r in rows], schema)
        frame.coalesce(1).write.mode("append").partitionBy("reading_date").parquet(path)

    table = lifecycle.Fleet(
        lambda: sensors, lambda: zones, lambda: spark.read.schema(schema).parquet(path), lambda: NOON
    )
    alerts = SnapshotStore(spark, f"{root}/alerts", schemas.ALERTS, schemas.ACTIVE_ALERT_STATUSES)
    recs = SnapshotStore(spark, f"{root}/recommendations", schemas.RECOMMENDATIONS, ("open",))
    assert alerts.rows().count() == 0

    def run():
        stream = views.table_stream(spark, path, schema, 1)
        drain(lifecycle.start_evaluation(
            "alerts", stream, f"{root}/checkpoints/alerts",
            lambda frame, batch: lifecycle.evaluate_alerts(frame, batch, table, alerts),
        ))
        drain(lifecycle.start_evaluation(
            "recommendations", stream, f"{root}/checkpoints/recommendations",
            lambda frame, batch: lifecycle.evaluate_recommendations(frame, batch, table, recs, alerts.current),
        ))

    arrive((1, minutes(9), 40.0), (2, minutes(9), 30.0), (3, minutes(9), 30.0))
    run()
    first = {(r.sensor_id, r.alert_type): r.status for r in alerts.rows().collect()}
    assert first == {(1, "threshold_high"): "open", (2, "threshold_low"): "open", (3, "threshold_low"): "open"}
    assert {(r.zone_id, r.recommendation_type): r.status for r in recs.rows().collect()} == {
        (1, "irrigation_needed"): "open", (2, "irrigation_needed"): "open",
    }
    ids = {r.sensor_id: r.id for r in alerts.rows().collect()}
    arrive((1, minutes(8), 22.0), (2, minutes(8), 60.0))
    run()
    second = {(r.sensor_id, r.alert_type): (r.status, r.id) for r in alerts.rows().collect()}
    assert second == {
        (1, "threshold_high"): ("resolved", ids[1]), (2, "threshold_low"): ("resolved", ids[2]),
        (3, "threshold_low"): ("open", ids[3]),
    }
    # only zone 1 was evaluated; its site's other open item is completed with it
    assert {r.zone_id: r.status for r in recs.rows().collect()} == {1: "completed", 2: "completed"}
    # running the last batch again leaves the same rows
    frame = spark.createDataFrame([(1, minutes(8), 22.0), (2, minutes(8), 60.0)], "sensor_id int, timestamp timestamp, value double")
    lifecycle.evaluate_alerts(frame, 1, table, alerts)
    assert alerts.latest_version() == 1
    assert {(r.sensor_id, r.alert_type): (r.status, r.id) for r in alerts.rows().collect()} == second
    # and the batch operators over everything agree on what is active
    whole = alert_ops.alert_evaluation(sensors, zones, table.readings(), NOON)
    assert {(r.sensor_id, r.alert_type) for r in alert_ops.fired(whole).collect()} == {(3, "threshold_low")}


def test_late_readings_reach_the_hourly_table(spark, fleet, tmp_path):
    sensors = fleet.sensors((1, 1, "temperature"), (2, 2, "humidity"))
    schema = "id long, sensor_id int, sensor_type string, timestamp timestamp, value double, is_outlier boolean"
    path, table = str(tmp_path / "clean"), str(tmp_path / "hours")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def stored():
        return spark.read.schema(schema).parquet(path)

    def run():
        stream = views.table_stream(spark, path, schema, 1)
        drain(views.start_hours(stream, stored, lambda: sensors, table, str(tmp_path / "checkpoint")))

    arrive((1, 1, "temperature", DAY, 20.0, False), (2, 2, "humidity", DAY, 60.0, False))
    arrive((3, 1, "temperature", DAY + timedelta(hours=30), 21.0, False))
    run()
    # two days late, into an hour that has rows and into one that had none
    arrive((4, 1, "temperature", DAY + timedelta(minutes=9), 30.0, False), (5, 2, "humidity", DAY + timedelta(hours=3), 61.0, False))
    run()
    expected = settled_hours(rollups.hourly_rollup(stored(), sensors))
    assert settled_hours(views.stored_hours(spark, table)) == expected and len(expected) == 4
    views.refresh_hours(stored(), stored, lambda: sensors, table)
    assert settled_hours(views.stored_hours(spark, table)) == expected
    views.refresh_hours(stored().limit(0), stored, lambda: sensors, table)
    assert views.stored_hours(spark, table).count() == 4


def test_only_the_dates_of_a_batch_are_read(spark, fleet, tmp_path):
    sensors, paths = fleet.sensors((1, 1, "temperature")), ingest.IngestPaths(str(tmp_path / "lake"))
    old, between = NOON - timedelta(days=9_000), NOON - timedelta(days=30)

    def arrive(batch, *rows):
        raw = [(json.dumps({"sensor_id": s, "timestamp": t.isoformat(), "value": v}),) for s, t, v in rows]
        ingest.ingest_batch(spark.createDataFrame(raw, "raw string"), batch, sensors, paths)

    arrive(0, (1, NOON, 1.0), (1, between, 2.0))
    for file in (tmp_path / "lake" / "readings" / f"reading_date={between.date()}").rglob("*.parquet"):
        file.write_bytes(b"whoever reads this fails")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    arrive(1, (1, old, 3.0), (1, NOON, 4.0), (1, NOON, 5.0))
    assert stats(spark, paths)[1] == (3, 1, 0, 2)


def test_a_failing_evaluation_stops_alone(spark, fleet, tmp_path):
    source, paths = tmp_path / "in", ingest.IngestPaths(str(tmp_path / "lake"))
    sensors, zones = fleet.sensors((1, 1, "soil_moisture")), fleet.zones(1)

    def broken(*_):
        raise RuntimeError("no detector today")

    def table(detector=None):
        return lifecycle.Fleet(
            lambda: sensors, lambda: zones, lambda: ingest.stored_readings(spark, paths), lambda: NOON, detector=detector
        )

    alerts = SnapshotStore(spark, str(tmp_path / "alerts"), schemas.ALERTS, schemas.ACTIVE_ALERT_STATUSES)
    recs = SnapshotStore(spark, str(tmp_path / "recs"), schemas.RECOMMENDATIONS, ("open",))

    def run(name, detector=None):
        write_lines(source, name, [(1, minutes(9 if name == "a.json" else 8), 30.0)])
        drain(ingest.start_ingest(ingest.document_stream(spark, str(source), 1), sensors, paths))
        stream = views.table_stream(spark, paths.readings, ingest.STORED, 1)
        evaluations = {
            "alerts": lambda frame, batch: lifecycle.evaluate_alerts(frame, batch, table(detector), alerts),
            "recs": lambda frame, batch: lifecycle.evaluate_recommendations(frame, batch, table(), recs, alerts.current),
        }
        started = {k: lifecycle.start_evaluation(k, stream, str(tmp_path / f"at_{k}"), f) for k, f in evaluations.items()}
        for query in started.values():
            try:
                query.awaitTermination(120)
            except Exception as error:
                assert "no detector today" in str(error)
        return {k: query.exception() is None for k, query in started.items()}

    assert run("a.json", broken) == {"alerts": False, "recs": True}
    assert alerts.rows().count() == 0 and recs.current().count() == 1
    assert run("b.json") == {"alerts": True, "recs": True}
    assert ingest.stored_readings(spark, paths).count() == 2
    assert [(r.alert_type, r.status) for r in alerts.rows().collect()] == [("threshold_low", "open")]
