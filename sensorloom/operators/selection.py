"""Exact order statistics of many groups at once, without sorting or gathering any group.

Selection by histograms: each wanted rank has an interval that holds it. One aggregate counts
the values of every interval in BUCKETS equal parts, with the least and greatest value of each
part; the part that holds the rank is the next interval, shrunk to its least and greatest value.
A rank is found when its interval is a single value; an interval of BUCKETS values or fewer is
counted value by value, so that round is its last. Each round narrows an interval a
thousandfold at least where values are spread, and always separates its two ends, so rounds
grow with the digits of the values and not with the number of rows. What comes to the driver in
a round is bounded by the wanted ranks times BUCKETS; groups are meant to be few (columns,
class labels), rows any number, and a value that very many rows share is one count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1_024

Interval = tuple[object, float, float, bool]  # group, low, high, and whether few values are inside


@dataclass(frozen=True)
class Found:
    """The value at a rank (from 0), and how many values of the group are less."""

    value: float
    less: int


def order_statistics(
    values: DataFrame, ranks: Callable[[int], Iterable[int]], group: str = "group", value: str = "value"
) -> dict:
    """For each group a dict of the wanted ranks, `ranks(n)` of its n values.

    `value` is a double; null and NaN are not counted, infinite values are an error. A null
    group is a group. Groups without values are absent.
    """
    given = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    spans = given.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    kind = given.schema["g"].dataType.simpleString()

    def counted(intervals: list[Interval]) -> DataFrame:
        sought = values.sparkSession.createDataFrame(
            [(i, *interval) for i, interval in enumerate(intervals)], f"span int, sg {kind}, low double, high double, few boolean"
        )
        # halves, so that the width of a span is finite; monotone in v, 0 at one end and 1 at the other
        width = F.col("high") / 2 - F.col("low") / 2
        tiny = F.when(F.col("v") > F.col("low"), 1.0).otherwise(0.0)  # halves of the least numbers are zero
        share = F.when(width > 0, F.try_divide(F.col("v") / 2 - F.col("low") / 2, width)).otherwise(tiny)
        part = F.when(F.col("few"), F.col("v")).otherwise(F.floor(share * (BUCKETS - 1)))
        inside = F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("low"), F.col("high"))
        return (
            given.join(F.broadcast(sought), inside)
            .groupBy("span", part.alias("bucket"))
            .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        )

    return _narrowed(spans, counted, ranks)


def _narrowed(spans: DataFrame, counted: Callable[[list[Interval]], DataFrame], ranks: Callable[[int], Iterable[int]]) -> dict:
    """The rounds: `spans` has g, n, low and high of each group, `counted` the parts of given intervals."""
    found: dict = {}
    open_spans: dict[tuple, list[int]] = {}  # group, low, high, less: ranks
    open_sizes: dict[tuple, int] = {}  # of the same intervals: how many values they hold
    for g, n, low, high in spans.collect():
        if math.isinf(low) or math.isinf(high):
            raise ValueError(f"group {g} has infinite values")
        found[g] = {}
        wanted = sorted(set(ranks(n)))
        if wanted and not 0 <= wanted[0] <= wanted[-1] < n:
            raise ValueError(f"group {g} has {n} values, wanted ranks {wanted}")
        if wanted:
            open_spans[g, low, high, 0], open_sizes[g, low, high, 0] = wanted, n
    while True:
        for span in [span for span in open_spans if span[1] == span[2]]:
            for rank in open_spans.pop(span):
                found[span[0]][rank] = Found(span[1], span[3])
        if not open_spans:
            return found
        places = list(open_spans)
        counts = counted([(*place[:3], open_sizes[place] <= BUCKETS) for place in places]).collect()
        parts: dict[int, list] = {}
        for row in counts:
            parts.setdefault(row.span, []).append(row)
        narrowed: dict[tuple, list[int]] = {}
        for i, place in enumerate(places):
            g, _, _, less = place
            wanted = open_spans[place]
            for row in sorted(parts[i], key=lambda row: row.bucket):
                inside = [rank for rank in wanted if less <= rank < less + row.n]
                if inside:
                    narrowed[g, row.low, row.high, less] = inside
                    open_sizes[g, row.low, row.high, less] = row.n
                less += row.n
        open_spans = narrowed


def _numbers(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)  # nulls are NaN
    return values[~np.isnan(values)]


class _Tally:
    """Counts and ends of the parts of one interval, in one task."""

    def __init__(self, low: float, high: float, few: bool):
        self.low, self.high, self.few, self.kept = low, high, few, []
        self.n = np.zeros(BUCKETS, np.int64)
        self.least, self.most = np.full(BUCKETS, np.inf), np.full(BUCKETS, -np.inf)

    def add(self, v: np.ndarray) -> None:
        v = np.sort(v[(v >= self.low) & (v <= self.high)])
        if self.few:
            self.kept.append(v)
        elif len(v):
            # halves, so that the width of a span is finite; halves of the least numbers are zero
            width = self.high / 2 - self.low / 2
            share = (v / 2 - self.low / 2) / width if width > 0 else v > self.low
            part = np.floor(share * (BUCKETS - 1)).astype(np.int64)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts[1:], len(v))
            at = part[starts]
            self.n[at] += ends - starts
            self.least[at] = np.minimum(self.least[at], v[starts])
            self.most[at] = np.maximum(self.most[at], v[ends - 1])

    def rows(self, span: int) -> pa.RecordBatch:
        if self.few:
            values, n = np.unique(np.concatenate([np.empty(0), *self.kept]), return_counts=True)
            found = [values, n, values, values]
        else:
            at = np.flatnonzero(self.n)
            found = [at.astype(float), self.n[at], self.least[at], self.most[at]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found[0]), span, np.int32)), *map(pa.array, found)], names=["span", "bucket", "n", "low", "high"]
        )


def medians(frame: DataFrame, columns: Iterable[str]) -> dict[str, float]:
    """The exact median of each numeric column, the mean of the two middle values of an even number.

    Columns without values are absent. Each task counts its batches column by column, so rows are
    not multiplied by the columns.
    """
    columns = list(columns)
    given = frame.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, column in enumerate(batch.columns):
                v = _numbers(column)
                if len(v):
                    rows.append((i, len(v), float(v.min()), float(v.max())))
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64())
            columns_found = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns_found, names=["g", "n", "low", "high"])

    def counted(intervals: list[Interval]) -> DataFrame:
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tallies = [_Tally(low, high, few) for _, low, high, few in intervals]
            for batch in batches:
                by_column = {g: _numbers(batch.column(g)) for g, *_ in intervals}
                for (g, *_), tally in zip(intervals, tallies):
                    tally.add(by_column[g])
            for i, tally in enumerate(tallies):
                yield tally.rows(i)

        found = given.mapInArrow(parts, "span int, bucket double, n long, low double, high double")
        return found.groupBy("span", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    each = given.mapInArrow(spans, "g int, n long, low double, high double").groupBy("g")
    ends = each.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = _narrowed(ends, counted, lambda n: {(n - 1) // 2, n // 2})
    return {columns[i]: sum(x.value for x in ranks.values()) / len(ranks) for i, ranks in found.items()}
