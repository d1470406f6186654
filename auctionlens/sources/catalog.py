"""Named inputs of the jobs, wherever they are stored."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from auctionlens.sources.readers import listed_hours, partition_hours, read_hourly


@dataclass(frozen=True)
class Table:
    """A table of the session catalog, partitioned by hour."""

    name: str


@dataclass(frozen=True)
class HourFolder:
    """A folder of hour partitions, with the schema of its rows."""

    path: str
    schema: StructType


Input = str | Table | HourFolder | DataFrame | Callable[[SparkSession], DataFrame]


class Catalog:
    """Maps input names to parquet paths, stored tables, DataFrames or functions of the session.

    ``renames`` adapts a warehouse's own column names, per table.
    """

    def __init__(
        self,
        spark: SparkSession,
        inputs: Mapping[str, Input],
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ) -> None:
        self.spark = spark
        self._inputs = dict(inputs)
        self._renames = dict(renames or {})

    def __getitem__(self, name: str) -> DataFrame:
        given = self._inputs[name]
        if isinstance(given, str):
            df = self.spark.read.parquet(given)
        elif isinstance(given, Table):
            df = self.spark.table(given.name)
        elif isinstance(given, HourFolder):
            df = read_hourly(self.spark, given.path, given.schema)
        elif callable(given):
            df = given(self.spark)
        else:
            df = given
        return df.withColumnsRenamed(dict(self._renames.get(name, {})))

    def hours(self, name: str) -> DataFrame:
        """``dh`` of the input: of a stored table from its partition names, of anything else from its rows."""
        given = self._inputs[name]
        if isinstance(given, Table):
            return partition_hours(self.spark, given.name)
        if isinstance(given, HourFolder):
            return listed_hours(self.spark, given.path)
        return self[name].select("dh").distinct()

    def __contains__(self, name: str) -> bool:
        return name in self._inputs

    def names(self) -> list[str]:
        return sorted(self._inputs)
