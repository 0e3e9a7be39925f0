"""Named queries over the star-schema tables, each a plain composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from sensorloom.functions.numeric import at_least_zero, nearest
from sensorloom.functions.status import deviation_percent, status_of
from sensorloom.functions.time import hours_before, instant, latest_timestamp
from sensorloom.operators import (
    alerts,
    anomaly,
    cleaning,
    history,
    ingestion,
    joins,
    models,
    overview,
    quality,
    rollups,
    selection,
)
from sensorloom.operators.recommend import candidates, context, lifecycle, rules
from sensorloom.operators.yields import evaluate, features, linear, score, split, train
from sensorloom.session import apply_runtime_conf
from sensorloom.settings import DEFAULTS, YIELD_BASELINES
from sensorloom.sources import star_schema
from sensorloom.sources.shared import written

# The events are sparse, about two per sensor and day, so trailing windows are a month
# long here and two readings count as sustained.
WIDE = replace(DEFAULTS, anomaly_max_age_hours=31 * 24, recent_hours=31 * 24, sustained_window=2)
WINDOW = ("2024-01-20T00:00:00Z", "2024-01-30T12:00:00Z")
INVENTORY_AT = "2024-01-02T00:00:00Z"
STORED_UNTIL = "2024-01-11T00:00:00Z"
PAGE_END = ("2024-01-25T00:00:00Z", 1000)
ALERTS_AT = "2024-01-20T00:00:00Z"
CHECKED_AT = "2024-01-31T00:00:00Z"
GAPS = {"co2_ppm": 7, "soil_pH": 5, "crop_type": 11}  # every so many records have none


class Star:
    """Frames over one directory; each is planned once per query."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = apply_runtime_conf(spark), directory

    def _load(self, loader, **options) -> DataFrame:
        return loader(self.spark, self.directory, **options)

    @cached_property
    def sensors(self):
        return self._load(star_schema.sensors)

    @cached_property
    def inventory(self):
        return self._load(star_schema.sensors, seen_before=INVENTORY_AT)

    @cached_property
    def zones(self):
        return self._load(star_schema.zones)

    @cached_property
    def greenhouses(self):
        return self._load(star_schema.greenhouses)

    @cached_property
    def readings(self):
        return self._load(star_schema.readings)

    @cached_property
    def repeated(self):
        return self._load(star_schema.repeated_readings)

    @cached_property
    def alerts(self):
        return self._load(star_schema.alerts)

    @cached_property
    def recommendations(self):
        return self._load(star_schema.recommendations)

    @cached_property
    def records(self):
        return self._load(star_schema.yield_records)

    @cached_property
    def stored_records(self):
        """The records and their places in the split's order; a fit reads them some ten times, so
        the order lines are folded once and stored."""
        lines = star_schema.order_lines(self.spark, self.directory).withColumn("place", split.place_of("record_id"))
        return star_schema.records_of(written(lines, "order-lines"), "place")

    @cached_property
    def with_split(self):
        return split.assign_split(self.stored_records, place=F.col("place")).drop("place")

    @cached_property
    def incomplete(self):
        """The records with their split and with gaps, as fields have them."""
        gap = {name: F.expr(f"if(record_id % {n} = 0, NULL, {name})") for name, n in GAPS.items()}
        return self.with_split.withColumns(gap)

    @cached_property
    def prepared(self):
        """Incomplete records with their features; what is learnt comes from the training rows."""
        return train.fit_preprocessor(self.incomplete).transform(self.incomplete)

    @cached_property
    def trained(self):
        """The candidates at full size on every training row, fitted by each query for itself."""
        return train.train(self.stored_records.drop("place"))

    @cached_property
    def documents(self):
        return self._load(star_schema.reading_documents)

    @property
    def now(self) -> Column:
        return latest_timestamp(self.readings)

    @cached_property
    def clean(self):
        return cleaning.clean_readings(self.readings, self.sensors)

    @cached_property
    def staged(self):
        return models.stg_sensor_readings(self.clean)

    @cached_property
    def dim_zone(self):
        return models.dim_zone(models.stg_zones(self.zones))

    @cached_property
    def fact(self):
        return models.fact_sensor_readings(
            self.staged, models.stg_sensors(self.sensors), models.stg_zones(self.zones)
        )

    @cached_property
    def summaries(self):
        return overview.sensor_summary(self.sensors, self.zones, self.readings, *WINDOW)

    @cached_property
    def counts(self):
        return overview.open_counts(self.greenhouses, self.alerts, self.recommendations)

    @cached_property
    def zone_overviews(self):
        return overview.zone_overview(self.zones, self.summaries)

    @cached_property
    def wide(self):
        return context.zone_wide_view(self.zones, self.sensors, self.readings, self.now, WIDE)

    @cached_property
    def predictions(self):
        """A closed-form stand-in for a model, so that its consumers can be checked in SQL."""
        value = at_least_zero(nearest("4D - abs(avg_temperature_C - 23D) / 10", 4))
        return score.zone_yield_inputs(self.wide).selectExpr("zone_id", f"{value} AS predicted_yield")

    @cached_property
    def context(self):
        zones = context.with_predictions(self.wide, self.predictions)
        return context.Context(zones, context.active_alerts(self.alerts, zones), "v1", WIDE)

    @cached_property
    def evaluation(self):
        return alerts.alert_evaluation(self.sensors, self.zones, self.readings, self.now, WIDE)


def plain(frame: DataFrame) -> DataFrame:
    """Zone-less timestamps and double numbers, for comparison with another engine."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def steady(column: str, digits: int) -> Column:
    """Round a sum-dependent double; the nudge keeps decimal ties from going either way.

    The result is that of ``round``, which goes through decimals; away from ties the nearest
    whole number of the scaled value gives the same at a small part of the cost.
    """
    nudged, scale = F.col(column) + 1e-9, float(10**digits)
    scaled = nudged * scale
    clear = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(clear, F.floor(scaled + 0.5) / scale).otherwise(F.round(nudged, digits)).alias(column)


def _steady(frame: DataFrame, **digits: int) -> DataFrame:
    return frame.withColumns({name: steady(name, places) for name, places in digits.items()})


Query = Callable[[Star], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- staging, dimensions, facts


@query
def stg_sensor_readings(s: Star):
    return s.staged


@query
def stg_sensors(s: Star):
    return models.stg_sensors(s.sensors)


@query
def stg_zones(s: Star):
    return models.stg_zones(s.zones)


@query
def stg_greenhouses(s: Star):
    return models.stg_greenhouses(s.greenhouses)


@query
def stg_alerts(s: Star):
    return models.stg_alerts(s.alerts)


@query
def dim_greenhouse(s: Star):
    return models.dim_greenhouse(models.stg_greenhouses(s.greenhouses))


@query
def dim_zone(s: Star):
    return s.dim_zone


@query
def dim_sensor(s: Star):
    return models.dim_sensor(models.stg_sensors(s.sensors))


@query
def dim_date(s: Star):
    # copies and outliers do not move the first and the last time, so neither is looked for
    possible = cleaning.possible_readings(s.readings, s.sensors)
    return models.dim_date(possible.withColumnRenamed("timestamp", "reading_timestamp"))


@query
def fact_sensor_readings(s: Star):
    return s.fact


# --- cleaning and roll-ups


@query
def bounds_filter(s: Star):
    typed = cleaning.attach_sensor_type(cleaning.normalise(cleaning.drop_incomplete(s.readings)), s.sensors)
    return cleaning.within_bounds(typed)


@query
def dedup_readings(s: Star):
    return cleaning.keep_newest(s.repeated)


@query
def rolling_zscore(s: Star):
    values = cleaning.normalise(s.readings)
    stats = cleaning.rolling_statistics(values)
    flag = cleaning.is_outlier(F.col("value"), F.col("rolling_mean"), F.col("rolling_std"), DEFAULTS.rolling_z)
    return _steady(stats.withColumn("is_outlier", flag), rolling_mean=6, rolling_std=4)


@query
def clean_readings(s: Star):
    return s.clean


@query
def hourly_rollup(s: Star):
    return _steady(rollups.hourly_rollup(s.clean, s.sensors), std_value=4)


@query
def hourly_zone_metrics(s: Star):
    hourly = rollups.hourly_rollup(s.clean, s.sensors)
    return _steady(rollups.hourly_zone_metrics(hourly, s.dim_zone), std_value=4)


@query
def daily_greenhouse_metrics(s: Star):
    return _steady(rollups.daily_greenhouse_metrics(s.fact, s.dim_zone), std_value=4)


@query
def sensor_health_summary(s: Star):
    return rollups.sensor_health_summary(s.fact, s.now)


# --- status, lookups, history, overviews


@query
def zone_targets_long(s: Star):
    return overview.zone_targets_long(s.zones)


@query
def resolved_ranges(s: Star):
    return overview.resolved_ranges(s.sensors, s.zones)


@query
def status_classification(s: Star):
    """Every reading of a sensor with a range, classified."""
    ranges = overview.resolved_ranges(s.sensors, s.zones).select("sensor_id", "range_min", "range_max")
    rows = joins.lookup_join(s.readings.withColumn("value", F.col("value").cast("double")), ranges, "sensor_id")
    measured = "value", "range_min", "range_max"
    return rows.selectExpr(
        "id", "sensor_id", "value", f"{status_of(*measured)} AS status", f"{deviation_percent(*measured)} AS deviation_percent"
    )


@query
def latest_readings(s: Star):
    return history.latest_readings(s.readings, s.sensors, s.zones)


@query
def sensor_stats(s: Star):
    return history.sensor_stats(s.readings, *WINDOW)


@query
def sensor_history(s: Star):
    return history.sensor_history(s.readings, s.sensors, 7, *WINDOW, limit=1000, offset=5)


@query
def greenhouse_history(s: Star):
    return history.greenhouse_history(s.readings, s.sensors, s.zones, 1, "humidity", *WINDOW, limit=1000)


@query
def recent_topn(s: Star):
    return history.recent_readings(s.readings, s.now, WIDE.anomaly_max_age_hours, WIDE.recent_rows)


@query
def multi_window_stats(s: Star):
    return history.multi_window_stats(s.readings, s.now)


@query
def readings_total(s: Star):
    return history.readings_total(s.readings)


@query
def history_after(s: Star):
    """The page of a sensor that follows a given row."""
    return history.sensor_history(s.readings, s.sensors, 7, *WINDOW, limit=20, after=PAGE_END)


@query
def alerts_after(s: Star):
    """The page of alerts that follows a given row."""
    return overview.listing(s.alerts, limit=50, after=PAGE_END, severity="warning")


@query
def greenhouse_listing(s: Star):
    return history.greenhouse_listing(s.greenhouses)


@query
def zones_of_greenhouse(s: Star):
    return history.zones_of_greenhouse(s.zones)


@query
def sensors_of_zone(s: Star):
    return history.sensors_of_zone(s.sensors)


@query
def sensor_summary(s: Star):
    return s.summaries


@query
def zone_overview(s: Star):
    return s.zone_overviews


@query
def greenhouse_overview(s: Star):
    return overview.greenhouse_overview(s.greenhouses, s.zone_overviews, s.counts, *WINDOW)


@query
def open_counts(s: Star):
    return s.counts


@query
def fleet_kpis(s: Star):
    return overview.fleet_kpis(s.summaries, s.counts)


@query
def topology(s: Star):
    nested = overview.topology(s.greenhouses, s.zones, s.sensors)
    text = F.transform("sensors", lambda x: F.concat_ws(":", x["id"], x["sensor_type"], x["unit"], x["status"]))
    return nested.withColumn("sensors", F.array_join(text, ","))


@query
def alerts_list(s: Star):
    return overview.listing(s.alerts, limit=50, offset=10, severity="warning", status="resolved")


@query
def alerts_list_total(s: Star):
    return overview.listing_total(s.alerts, severity="warning", status="resolved")


@query
def recommendations_list(s: Star):
    return overview.listing(s.recommendations, limit=50, priority="high", status="completed")


@query
def recommendations_list_total(s: Star):
    return overview.listing_total(s.recommendations, priority="high", status="completed")


@query
def alert_banner(s: Star):
    return overview.alert_banner(s.alerts)


# --- anomalies and alerts


@query
def anomaly_latest(s: Star):
    scored = anomaly.anomaly_latest(s.readings, s.now, replace(WIDE, anomaly_z=2.0))
    return _steady(scored, z_score=4, mean=6, std=4)


@query
def threshold_alerts(s: Star):
    return alerts.fired(alerts.threshold_evaluation(s.sensors, s.zones, s.readings, ALERTS_AT))


@query
def anomaly_alerts(s: Star):
    return alerts.fired(
        alerts.anomaly_evaluation(s.sensors, s.zones, s.readings, s.now, replace(WIDE, anomaly_z=2.0))
    )


@query
def alert_reconcile(s: Star):
    changes = alerts.alert_reconcile(s.alerts, s.evaluation, s.now)
    known = F.when(F.col("action") != "insert", F.col("id"))
    return changes.withColumn("id", known)


@query
def alert_transitions(s: Star):
    at = F.col("created_at")
    acknowledge = s.alerts.filter("severity IN ('critical', 'warning')").select(
        "id", F.lit("acknowledge").alias("action"), (at + F.expr("INTERVAL 5 MINUTES")).alias("at")
    )
    resolve = s.alerts.filter("severity IN ('info', 'warning')").select(
        "id", F.lit("resolve").alias("action"), (at + F.expr("INTERVAL 3 MINUTES")).alias("at")
    )
    return alerts.alert_transitions(s.alerts, acknowledge.unionByName(resolve))


# --- recommendations


@query
def zone_wide_view(s: Star):
    return s.wide


def _single(s: Star, *names: str) -> DataFrame:
    chosen = [rule for rule in rules.RULES if rule.name in names]
    return candidates.all_candidates(s.context, chosen).drop("source_id")


@query
def rule_irrigation(s: Star):
    return _single(s, "irrigation_needed")


@query
def sustained_temperature(s: Star):
    return _single(s, "temperature_high", "temperature_low")


@query
def rule_humidity(s: Star):
    return _single(s, "humidity_high_risk")


@query
def rule_co2(s: Star):
    return _single(s, "co2_out_of_range")


@query
def rule_anomaly_review(s: Star):
    return _single(s, "anomaly_review")


@query
def rule_yield_risk(s: Star):
    return _single(s, "yield_risk")


@query
def recommendation_candidates(s: Star):
    return candidates.recommendation_candidates(s.context).drop("source_id")


@query
def recommendation_reconcile(s: Star):
    proposed = candidates.recommendation_candidates(s.context)
    types = candidates.ready_rules(s.context)[1]
    changes = lifecycle.recommendation_reconcile(s.recommendations, proposed, s.context.zones, s.now, types=types)
    return changes.withColumn("id", F.when(F.col("action") != "insert", F.col("id")))


def _touched_zones(s: Star) -> DataFrame:
    recent = s.readings.filter(F.col("timestamp") >= hours_before(s.now, 6))
    touched = lifecycle.affected_zones(recent, s.sensors)
    return s.context.zones.join(touched, "zone_id", "left_semi")


@query
def recommendation_reconcile_stats(s: Star):
    """Only the zones with readings in the last six hours are evaluated; others are kept."""
    zones = _touched_zones(s)
    here = replace(s.context, zones=zones, open_alerts=context.active_alerts(s.alerts, zones))
    changes = lifecycle.recommendation_reconcile(
        s.recommendations, candidates.recommendation_candidates(here), zones, s.now, scope="zones"
    )
    return lifecycle.reconcile_stats(changes)


@query
def recommendation_transitions(s: Star):
    at = F.col("created_at")
    dismiss = s.recommendations.filter("priority IN ('high', 'critical')").select(
        "id", F.lit("dismiss").alias("action"), (at + F.expr("INTERVAL 2 HOURS")).alias("at")
    )
    complete = s.recommendations.filter("priority IN ('medium', 'critical')").select(
        "id", F.lit("complete").alias("action"), (at + F.expr("INTERVAL 1 HOUR")).alias("at")
    )
    return lifecycle.recommendation_transitions(s.recommendations, dismiss.unionByName(complete))


@query
def affected_zones(s: Star):
    recent = s.readings.filter(F.col("timestamp") >= hours_before(s.now, 6))
    return lifecycle.affected_zones(recent, s.sensors)


# --- ingestion


@query
def ingest_validate(s: Star):
    parsed = ingestion.parse_readings(s.documents)
    return parsed.select("seq", "sensor_id", "timestamp", "value", "problem")


@query
def ingest_stats(s: Star):
    """The hourly-clock readings sent again after the first ten days were stored."""
    batch = s.repeated.withColumnRenamed("id", "seq")
    stored = s.repeated.filter(F.col("timestamp") < instant(STORED_UNTIL)).select("sensor_id", "timestamp")
    return ingestion.ingest_stats(batch, s.inventory, stored)


# --- data quality


@query
def dq_freshness(s: Star):
    return quality.fresh_readings(s.readings, CHECKED_AT)


@query
def dq_gap(s: Star):
    return quality.no_ingestion_gap(s.readings, CHECKED_AT)


@query
def dq_duplicates(s: Star):
    return quality.no_duplicates(s.repeated)


@query
def dq_orphans(s: Star):
    return quality.no_orphans(s.readings, s.inventory)


@query
def dq_impossible(s: Star):
    return quality.no_impossible_values(s.readings, s.sensors)


@query
def dq_unique(s: Star):
    return quality.combine([
        quality.unique(s.readings, ["id"], "readings.id"),
        quality.unique(s.sensors, ["id"], "sensors.id"),
        quality.unique(s.zones, ["id"], "zones.id"),
        quality.unique(s.repeated, ["sensor_id", "timestamp"], "readings.hour"),
    ])


@query
def dq_not_null(s: Star):
    return quality.combine([
        quality.not_null(s.readings, ["id", "sensor_id", "timestamp", "value"], "readings"),
        quality.not_null(s.alerts, ["sensor_id", "acknowledged_at", "resolved_at"], "alerts"),
    ])


@query
def dq_relationships(s: Star):
    return quality.combine([
        quality.relationships(s.sensors, "zone_id", s.zones, "id", "sensors.zone_id"),
        quality.relationships(s.zones, "greenhouse_id", s.greenhouses, "id", "zones.greenhouse_id"),
        quality.relationships(s.readings, "sensor_id", s.inventory, "id", "readings.sensor_id"),
    ])


@query
def dq_accepted_values(s: Star):
    from sensorloom import schemas

    return quality.combine([
        quality.accepted_values(s.sensors, "sensor_type", schemas.SENSOR_TYPES, "sensors.sensor_type"),
        quality.accepted_values(s.zones, "crop_type", schemas.CROP_TYPES, "zones.crop_type"),
        quality.accepted_values(s.alerts, "status", schemas.ACTIVE_ALERT_STATUSES, "alerts.status"),
    ])


@query
def dq_target_ranges(s: Star):
    return quality.ordered_targets(s.zones)


@query
def dq_open_unique(s: Star):
    return quality.combine([
        quality.one_active_alert(s.alerts),
        quality.one_open_recommendation(s.recommendations),
    ])


# --- yields


@query
def yield_features(s: Star):
    return features.add_derived(s.records).select("record_id", *features.DERIVED)


@query
def yield_split(s: Star):
    return s.with_split.select("record_id", "crop_type", "split")


@query
def yield_request_validation(s: Star):
    checked = score.validate_requests(s.records)
    return checked.select("record_id", F.array_join("failures", ",").alias("failures"), "accepted")


@query
def regression_metrics(s: Star):
    """The fixed crop baselines taken as predictions, per crop."""
    pairs = [x for crop, base in YIELD_BASELINES.items() for x in (F.lit(crop), F.lit(base))]
    scored = s.records.withColumn("prediction", F.create_map(*pairs)[F.lower("crop_type")])
    metrics = evaluate.regression_metrics(scored, features.TARGET, "prediction", "crop_type")
    return _steady(metrics, mae=6, rmse=6, r2=6, mape=4)


@query
def zone_yield_inputs(s: Star):
    return score.zone_yield_inputs(s.wide)


@query
def yield_medians(s: Star):
    """Exact medians of the features over the training rows, by distributed selection."""
    middle = selection.medians(features.add_derived(s.incomplete.filter("split = 'train'")), features.FEATURES)
    return s.spark.createDataFrame(sorted(middle.items()), "feature string, median double")


@query
def yield_preprocess(s: Star):
    prepared = s.prepared.select("record_id", "split", *features.prepared_columns(s.prepared))
    return _steady(prepared, **{name: 6 for name in map(features.scaled_name, features.FEATURES)})


@query
def yield_moments(s: Star):
    """What the linear fit needs to know of the training rows: one aggregate."""
    names = [*map(features.scaled_name, features.FEATURES), features.TARGET]
    return _steady(linear.moments(s.prepared.filter("split = 'train'"), names), mean_product=6)


@query
def yield_linear(s: Star):
    """Least-squares predictions of every record, by a fit on the training rows."""
    names = features.prepared_columns(s.prepared)
    model = linear.fit(s.prepared.filter("split = 'train'"), features.TARGET, names)
    return s.prepared.select("record_id", "split", model.predict().alias("predicted_yield"))


@query
def yield_leaderboard(s: Star):
    return train.leaderboard_document(s.trained)


@query
def yield_scores(s: Star):
    return score.score(s.trained.best_pipeline(), score.validate_requests(s.records).filter("accepted"))


@query
def dataset_fingerprint(s: Star):
    return train.dataset_fingerprint(s.records)


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query as a function of a session and a directory of tables."""

    def bind(build: Query):
        return lambda spark, directory: plain(build(Star(spark, directory)))

    return {name: bind(build) for name, build in QUERIES.items()}
