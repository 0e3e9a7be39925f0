"""Relational tables over JDBC, read in parallel and replaced in place."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcTable:
    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict)
    partition_column: str | None = None
    lower_bound: int | str | None = None
    upper_bound: int | str | None = None
    partitions: int = 32
    fetch_rows: int = 10_000
    single_task: bool = False  # for tables known to be small

    def read_options(self) -> dict[str, str]:
        """Options of a read split by ranges of the partition column, when there is one."""
        options = {"url": self.url, "dbtable": self.table, "fetchsize": str(self.fetch_rows), **self.properties}
        if self.partition_column is not None:
            if self.lower_bound is None or self.upper_bound is None:
                raise ValueError("a partition column needs both bounds")
            options |= {
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower_bound),
                "upperBound": str(self.upper_bound),
                "numPartitions": str(self.partitions),
            }
        return options

    def write_options(self) -> dict[str, str]:
        """Options of a full refresh that empties the table and keeps its definition."""
        return {
            "url": self.url,
            "dbtable": self.table,
            "truncate": "true",
            "numPartitions": str(self.partitions),
            **self.properties,
        }


def read_jdbc(spark: SparkSession, source: JdbcTable) -> DataFrame:
    """The table in ranges of its partition column; in one task only where that is asked for."""
    if source.partition_column is None and not source.single_task:
        raise ValueError(f"{source.table} needs a partition column with bounds, or single_task=True if it is small")
    return spark.read.format("jdbc").options(**source.read_options()).load()


def replace_jdbc(frame: DataFrame, target: JdbcTable) -> None:
    frame.write.format("jdbc").mode("overwrite").options(**target.write_options()).save()
