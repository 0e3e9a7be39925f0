"""From raw readings to typed, de-duplicated readings with an outlier flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.joins import lookup_join
from sensorloom.settings import DEFAULTS, IMPOSSIBLE_BOUNDS

BLOCK_ROWS = 250_000
MOST_BLOCK_ROWS = 4_000_000
_HALF_BITS = 20
_HALF = 1 << _HALF_BITS


def drop_incomplete(readings: DataFrame) -> DataFrame:
    return readings.na.drop(subset=["sensor_id", "timestamp", "value"])


def normalise(readings: DataFrame) -> DataFrame:
    """UTC instants and double values."""
    return readings.withColumns(
        {"timestamp": F.col("timestamp").cast("timestamp"), "value": F.col("value").cast("double")}
    )


def attach_sensor_type(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Add the sensor's type; readings of unknown sensors are dropped."""
    types = sensors.select(F.col("id").alias("sensor_id"), "sensor_type")
    return lookup_join(readings, types, "sensor_id")


def is_possible(
    sensor_type: Column, value: Column, bounds: dict[str, tuple[float, float]] = IMPOSSIBLE_BOUNDS
) -> Column:
    """True inside the type's bounds; false outside and for types without bounds."""
    tests = [(sensor_type == kind) & value.between(low, high) for kind, (low, high) in bounds.items()]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def within_bounds(
    readings: DataFrame, bounds: dict[str, tuple[float, float]] = IMPOSSIBLE_BOUNDS
) -> DataFrame:
    return readings.filter(is_possible(F.col("sensor_type"), F.col("value"), bounds))


def keep_newest(readings: DataFrame) -> DataFrame:
    """One reading per (sensor, time): the one inserted last.

    The rank filter is planned as a group limit on both sides of the exchange, so a
    pile of copies shrinks to one row per task before it is shuffled.
    """
    newest = Window.partitionBy("sensor_id", "timestamp").orderBy(F.col("id").desc())
    return readings.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


_SECOND = "minute(timestamp) * 60 + second(timestamp)"
_PIECE = "pmod(unix_micros(timestamp), 1000000) div 15625"


def block_map(times: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """For each hour of each sensor with more than ``block_rows`` readings, the blocks its readings serve.

    Blocks are made of whole slots, so counts alone deal them out and no reading is ranked for
    it. A slot is an hour, or a second where an hour would be more than an eighth of a block.
    It serves the block it starts in and each later one whose first frame could reach it: slots
    are laid out by the number of 64ths of a second with a reading, which is never more than
    their distinct times, so copies among ``times`` do not shorten what a block receives.
    ``serves`` has one entry for an hour and 3,600 for an hour that is cut into seconds.
    """
    keys = ["sensor_id", "_hour"]
    hours = (
        times.groupBy("sensor_id", F.date_trunc("hour", "timestamp").alias("_hour"), F.expr(_SECOND).alias("_second"))
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.expr(f"least(bit_count(bit_or(shiftleft(1L, CAST({_PIECE} AS INT)))), {rows})").alias("_least"),
        )
        .groupBy(*keys)
        .agg(
            F.sum("_rows").alias("_rows"), F.least(F.sum("_least"), F.lit(rows)).cast("int").alias("_least"),
            F.collect_list(F.struct("_second", "_rows", "_least")).alias("_cut"),
        )
    )
    whole = "array(struct(CAST(NULL AS INT) AS _second, _rows, _least))"
    slots = hours.selectExpr(*keys, f"inline(if(_rows > {block_rows // 8}, _cut, {whole}))")
    by_time = Window.partitionBy("sensor_id").orderBy("_hour", "_second")
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)
    in_reach = Window.partitionBy("sensor_id").orderBy("_place").rangeBetween(0, 2 * rows - 1)
    dealt = (
        slots.withColumns({
            "_start": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_place": F.coalesce(F.sum("_least").over(earlier), F.lit(0)),
            "_total": F.sum("_rows").over(Window.partitionBy("sensor_id")),
        })
        .filter(F.col("_total") > block_rows)
        .withColumn("_block", F.expr(f"_start div {block_rows}"))
        .withColumn("_near", F.collect_list(F.struct("_place", "_block")).over(in_reach))
        .withColumn("_blocks", F.expr(
            "array_union(array(_block), "
            f"transform(filter(_near, x -> x._place < _place + _least + {rows}), x -> x._block))"
        ))
    )
    each_second = "transform(sequence(0, 3599), s -> _by_second[s])"
    return (
        dealt.groupBy(*keys)
        .agg(
            F.first("_blocks").alias("_whole"),
            F.map_from_entries(F.collect_list(F.expr("if(_second IS NULL, NULL, struct(_second, _blocks))"))).alias("_by_second"),
        )
        .select(*keys, F.expr(f"if(size(_by_second) = 0, array(_whole), {each_second})").alias("serves"))
    )


def in_blocks(
    readings: DataFrame, rows: int, block_rows: int = BLOCK_ROWS, times: DataFrame | None = None
) -> DataFrame:
    """Deal readings to blocks of their sensor's series: ``_block``, and ``_own`` where they belong to it.

    A block holds its own readings and at least the ``rows`` before them, where there are so
    many. It has up to ``block_rows`` readings, the rest of the slot that fills it and the
    slots that hold the frame: an eighth of a block each, or what a sensor sends in a second.
    ``times`` may name a cheaper frame with the same (sensor, time) pairs, repeats allowed, to
    count from; repeats make blocks smaller, not wrong.
    """
    hour = F.date_trunc("hour", "timestamp").alias("_hour")
    deal = block_map(readings if times is None else times, rows, block_rows)
    served = readings.select("*", hour).join(deal, ["sensor_id", "_hour"], "left")
    entry = f"if(size(serves) = 1, serves[0], serves[{_SECOND}])"
    return (
        served.select("*", F.posexplode(F.expr(f"if(serves IS NULL, array(0L), {entry})")).alias("_nth", "_block"))
        .withColumn("_own", F.col("_nth") == 0)
        .drop("_hour", "serves", "_nth")
    )


def rolling_statistics(
    readings: DataFrame,
    rows: int = DEFAULTS.rolling_rows,
    block_rows: int = BLOCK_ROWS,
    times: DataFrame | None = None,
) -> DataFrame:
    """Mean and population deviation of the ``rows`` readings before each reading.

    A sensor's series is cut into blocks (``in_blocks``), each with the readings its first
    frames need. The frame is counted in rows, so this overlap makes every block's result
    exact, however much of the data one sensor sends.

    Inside a block a frame is the difference of running sums, one step per row in place
    of one per row and frame. Values have four decimals, so they scale to whole numbers
    below 2**40; squares are summed as the three products of their halves, each of which
    fits a long for any block, and are put together in decimals. Every sum is exact, so
    nothing cancels. Missing values, NaN and values of 2**40 / 10,000 or more take their
    place in a frame but do not count in its statistics. Repeated times are ordered by
    ``id`` where there is one.
    """
    if not rows <= block_rows <= MOST_BLOCK_ROWS:
        raise ValueError(f"block_rows must be {rows}..{MOST_BLOCK_ROWS}")
    ties = [name for name in ("id",) if name in readings.columns]  # repeated times keep one order
    by_time = Window.partitionBy("sensor_id", "_block").orderBy("timestamp", *ties)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    scaled = f"if(abs(value) < {1 << 2 * _HALF_BITS} / 10000D, CAST(round(value * 10000) AS BIGINT), NULL) AS _x"
    parts = {"_sum": "_x", "_hh": "_h * _h", "_hl": "_h * _l", "_ll": "_l * _l"}
    running = {name: F.coalesce(F.sum(F.expr(text)).over(before), F.lit(0)) for name, text in parts.items()}
    running["_count"] = F.count("_x").over(before)
    in_frame = {name: F.col(name) - F.lag(name, rows, 0).over(by_time) for name in running}
    count = "nullif(_count, 0)"
    whole = {name: f"CAST({name} AS DECIMAL(20,0))" for name in parts}
    squares = (
        f"({whole['_hh']} * CAST({_HALF * _HALF} AS DECIMAL(13,0)) "
        f"+ {whole['_hl']} * CAST({2 * _HALF} AS DECIMAL(7,0)) + {whole['_ll']})"
    )
    spread = f"CAST({count} * {squares} - {whole['_sum']} * {whole['_sum']} AS DOUBLE)"
    return (
        in_blocks(readings, rows, block_rows, times)
        .select("*", F.expr(scaled))
        .selectExpr("*", f"_x & {_HALF - 1} AS _l", f"shiftright(_x, {_HALF_BITS}) AS _h")
        .withColumns(running)
        .withColumns(in_frame)
        .filter("_own")
        .withColumns({
            "rolling_mean": F.expr(f"CAST(_sum AS DOUBLE) / {count} / 10000D"),
            "rolling_std": F.expr(f"sqrt({spread}) / {count} / 10000D"),
        })
        .drop("_block", "_own", "_x", "_h", "_l", *running)
    )


def is_outlier(value: Column, mean: Column, std: Column, z: float) -> Column:
    """More than ``z`` deviations away; false without a spread to compare with."""
    score = F.abs((value - mean) / F.nullif(std, F.lit(0.0)))
    return F.coalesce((std > 0) & (score > z), F.lit(False))


def flag_outliers(
    readings: DataFrame,
    z: float = DEFAULTS.rolling_z,
    rows: int = DEFAULTS.rolling_rows,
    block_rows: int = BLOCK_ROWS,
    times: DataFrame | None = None,
) -> DataFrame:
    flag = is_outlier(F.col("value"), F.col("rolling_mean"), F.col("rolling_std"), z)
    return (
        rolling_statistics(readings, rows, block_rows, times)
        .withColumn("is_outlier", flag)
        .drop("rolling_mean", "rolling_std")
    )


def possible_readings(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Complete, typed readings inside their bounds; copies still in."""
    return within_bounds(attach_sensor_type(normalise(drop_incomplete(readings)), sensors))


def clean_readings(
    readings: DataFrame,
    sensors: DataFrame,
    z: float = DEFAULTS.rolling_z,
    rows: int = DEFAULTS.rolling_rows,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Typed, de-duplicated readings with their outlier flag.

    Bounds come before the duplicate rule: an impossible newest copy must not hide an
    older valid one.
    """
    possible = possible_readings(readings, sensors)
    flagged = flag_outliers(keep_newest(possible), z, rows, block_rows, times=possible)
    return flagged.select(
        F.col("id").cast("long"),
        F.col("sensor_id").cast("int"),
        F.col("sensor_type").cast("string"),
        F.col("timestamp").cast("timestamp"),
        F.col("value").cast("double"),
        F.col("is_outlier").cast("boolean"),
    )
