"""Versioned Parquet snapshots of lifecycle rows (alerts, recommendations).

Versions count up from 0: one for each evaluated batch and one for each set of stored actions.
Active rows are rewritten with every version, closed rows are written once, under the version
that closed them. Folders are slots that are used in turn, so their number stays bounded:
``fan`` versions of closed rows are folded into one slot of the next level, ``fan`` of those
into one of the level above. A slot is used again only after twice ``fan`` turns, so nothing
that a version is made from is overwritten before it is committed, and a write that was cut
off is simply made again. A version counts from the moment its commit exists.

One driver writes a store; its threads take turns. Any number of sessions may read.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sensorloom.functions.time import Instant, instant

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TURNS: dict[str, threading.RLock] = {}


@dataclass(frozen=True)
class Turn:
    """A version to be written: what it follows, the batch it evaluates and its clock."""

    version: int
    batch: int | None
    at: datetime


@dataclass(frozen=True)
class SnapshotStore:
    spark: SparkSession
    root: str
    schema: StructType
    active_statuses: tuple[str, ...]
    fan: int = 8

    def _slot(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}/slot_{number % (2 * self.fan)}"

    def _read(self, path: str, schema: StructType | str) -> DataFrame | None:
        """All rows under a path; a slot that is being replaced meanwhile is passed over."""
        reader = self.spark.read.schema(schema).options(recursiveFileLookup="true", ignoreMissingFiles="true")
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _write_one(self, path: str, **values: int | None) -> None:
        row = self.spark.range(0, 1, 1, 1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])
        row.write.mode("overwrite").parquet(path)

    def _newest(self) -> tuple[int | None, int | None]:
        """The newest version and the last batch evaluated so far; at most two ``fan`` rows are read."""
        commits = self._read(f"{self.root}/commits", "version long, batch long")
        return (None, None) if commits is None else tuple(commits.agg(F.max("version"), F.max("batch")).first())

    def latest_version(self) -> int | None:
        return self._newest()[0]

    @property
    def _versioned(self) -> StructType:
        return StructType([*self.schema.fields, StructField("_version", LongType())])

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def active(self, version: int | None) -> DataFrame:
        """Active rows as of a version; no rows before the first. The last 2 * ``fan`` are kept."""
        if version is None:
            return self._empty()
        newest = self.latest_version()
        if newest is None or not newest - 2 * self.fan < version <= newest:
            raise ValueError(f"version {version} is not kept")
        rows = self._read(self._slot("active", version), self._versioned)
        return rows.filter(F.col("_version") == version).drop("_version")

    def current(self) -> DataFrame:
        """Active rows of the newest version."""
        return self.active(self.latest_version())

    def _closed(self, level: int, since: int, until: int) -> DataFrame:
        """Rows that closed with the versions since .. until - 1, from one level; they keep their version."""
        rows = self._read(f"{self.root}/closed_{level}", self._versioned)
        rows = self._empty().withColumn("_version", F.lit(None).cast("long")) if rows is None else rows
        return rows.filter((F.col("_version") >= since) & (F.col("_version") < until))

    def rows(self, version: int | None = None) -> DataFrame:
        """Every row as of a version, the latest by default."""
        newest = self.latest_version()
        if newest is None:
            return self.active(version)
        version = newest if version is None else version
        found = self.active(version)
        # the levels are as the newest version left them; an older one reads a part of them
        level, until = 0, newest + 1
        while until > 0:
            size = self.fan ** (level + 1)
            since = newest // size * size
            if since < min(until, version + 1):
                closed = self._closed(level, since, min(until, version + 1))
                found = found.unionByName(closed.drop("_version"))
            level, until = level + 1, since
        return found

    @contextmanager
    def turn(self, clock: Callable[[], Instant], batch: int | None = None) -> Iterator[Turn | None]:
        """Hold the store for one new version; None for a batch that was evaluated before.

        The clock of a batch is stored before it is evaluated: if the batch fails and runs again,
        it sees the same clock and gives new rows the same ids.
        """
        with _TURNS.setdefault(self.root, threading.RLock()):
            version, last = self._newest()
            if batch is not None and last is not None and batch <= last:
                yield None
                return
            at = None
            if batch is not None:
                begun = self._read(self._slot("begun", batch), "batch long, at long")
                at = None if begun is None else begun.filter(F.col("batch") == batch).agg(F.max("at")).first()[0]
            if at is None:
                at = self.spark.range(0, 1, 1, 1).select(F.unix_micros(instant(clock()))).first()[0]
                if batch is not None:
                    self._write_one(self._slot("begun", batch), batch=batch, at=at)
            next_version = 0 if version is None else version + 1
            yield Turn(next_version, batch, _EPOCH + timedelta(microseconds=at))

    def before(self, turn: Turn) -> DataFrame:
        """Active rows of the version that a turn follows."""
        return self.active(turn.version - 1 if turn.version else None)

    def _fold(self, version: int) -> None:
        """Move closed rows up a level where a version starts a new run of them."""
        level, size = 1, self.fan
        while version and version % size == 0:
            full = self._closed(level - 1, version - size, version)
            full.hint("rebalance").write.mode("overwrite").parquet(
                self._slot(f"closed_{level}", version // size - 1)
            )
            level, size = level + 1, size * self.fan

    def write(self, turn: Turn, frame: DataFrame) -> None:
        """Store the rows of a version: still active ones and those that just closed."""
        is_active = F.col("status").isin(*self.active_statuses)
        self._fold(turn.version)
        rows = frame.select(*self.schema.fieldNames(), F.lit(turn.version).cast("long").alias("_version")).persist()
        try:
            for kind, part in (("active", is_active), ("closed_0", ~is_active)):
                rows.filter(part).write.mode("overwrite").parquet(self._slot(kind, turn.version))
        finally:
            rows.unpersist()
        last = self._newest()[1] if turn.batch is None else turn.batch
        self._write_one(self._slot("commits", turn.version), version=turn.version, batch=last)

    def store_actions(
        self, actions: DataFrame, transitions: Callable[[DataFrame, DataFrame], DataFrame], clock: Callable[[], Instant]
    ) -> list[int]:
        """Apply requested transitions (id, action, at) as a version; returns the requested ids that no row has.

        Closed rows do not change any more. The result is as long as the request at most.
        """
        with self.turn(clock) as turn:
            wanted = actions.select("id").distinct()
            known = self.rows().select("id").join(wanted, "id", "left_semi").distinct()
            unknown = [r.id for r in wanted.join(known, "id", "left_anti").collect()]
            self.write(turn, transitions(self.before(turn), actions))
        return unknown
