"""A journal of what has been written, one entry per hour (and batch).

Data is written first and journaled afterwards. What is not in the journal counts
as not written: a run that dies in between is simply repeated, and since both the
data and the entries are overwritten by hour and batch, nothing doubles.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionlens.sources.sinks import overwrite_partitions

LEDGER = "n_rows bigint, dh string, batch bigint"

#: The batch of whole loads, which have no batches.
WHOLE = -1


class HourLedger:
    """Committed hours of one stored table, kept as a small parquet table at ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """``dh``, ``batch``, ``n_rows`` of everything committed so far; none before the first commit."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException:  # there is no such folder yet
            return self.spark.createDataFrame([], LEDGER)

    def hours(self) -> DataFrame:
        return self.entries().select("dh").distinct()

    def missing(self, hours: DataFrame) -> DataFrame:
        """The given hours that have not been committed."""
        return hours.join(self.entries().select("dh"), "dh", "left_anti")

    def commit(self, counts: DataFrame, batch: int = WHOLE) -> None:
        """Journal ``dh`` and ``n_rows``; an hour of the same batch replaces its entry."""
        entries = counts.select(F.col("n_rows").cast("bigint"), "dh", F.lit(batch).cast("bigint").alias("batch"))
        overwrite_partitions(entries, self.path, ("dh", "batch"))

    def has_batch(self, batch: int) -> bool:
        return bool(self.entries().where(F.col("batch") == batch).take(1))

    def differing(self, stored: DataFrame) -> DataFrame:
        """Hours whose stored rows are not as many as were journaled: ``dh``, ``journaled``, ``stored``."""
        journaled = self.entries().groupBy("dh").agg(F.sum("n_rows").alias("journaled"))
        found = stored.groupBy("dh").agg(F.count(F.lit(1)).alias("stored"))
        return (
            journaled.join(found, "dh", "full")
            .select("dh", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("journaled", "stored")])
            .where("journaled <> stored")
        )


def committed(stored: DataFrame, ledger: HourLedger) -> DataFrame:
    """The rows of a table partitioned by hour and batch whose batch has been journaled."""
    return stored.join(ledger.entries().select("dh", "batch"), ["dh", "batch"], "left_semi")
