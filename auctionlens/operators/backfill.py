"""Which hours are ready to aggregate, still to load, or past retention.

Every function here takes hours from any relation with a ``dh`` column. Where that
is a list of partition names (``readers.partition_hours``, ``readers.listed_hours``)
or a journal, planning reads no data; rows of a log give the same hours, at the
price of a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.timeparts import HOUR_FORMAT, as_of_time, shift_hour
from auctionlens.operators.attribution import in_hours


def hours_of(table: DataFrame) -> DataFrame:
    """Distinct hours that hold at least one row; reads the partition column only."""
    return table.select("dh").distinct()


def _cutoff(as_of: str, days: int) -> str:
    return (as_of_time(as_of) - timedelta(days=days)).strftime(HOUR_FORMAT)


#: What an hour needs to be ready, and what rules it out, as bits.
_IMPS, _BIDS, _CLICKS, _FOLLOWED, _DONE = 1, 2, 4, 8, 16


def ready_hours(
    imps: DataFrame, bids: DataFrame, clicks: DataFrame, aggregated: DataFrame, as_of: str, lookback_days: int = 8
) -> DataFrame:
    """Hours populated in all three logs, not aggregated yet, whose next click hour is there.

    Every log gives its distinct hours after the cut-off, once, and each of these
    sets a bit; an hour without rows sets none. Partitions before the cut-off
    are pruned in every log, as the next hour of a wanted one is after it too.
    """
    # "Later than the cut-off": on a whole hour the hour itself is too old.
    first = _cutoff(as_of, lookback_days)

    def recent(table: DataFrame) -> DataFrame:
        return hours_of(table.where(F.col("dh") > first))

    def marked(table: DataFrame, bit: int) -> DataFrame:
        return recent(table).select("dh", F.lit(bit).alias("bit"))

    # A click hour also follows the hour before it.
    marks = F.array(
        F.struct(F.col("dh"), F.lit(_CLICKS).alias("bit")),
        F.struct(shift_hour(F.col("dh"), -1).alias("dh"), F.lit(_FOLLOWED).alias("bit")),
    )
    clicked = recent(clicks).select(F.inline(marks))
    logs = marked(imps, _IMPS).union(marked(bids, _BIDS)).union(marked(aggregated, _DONE)).union(clicked)
    return (
        logs.groupBy("dh")
        .agg(F.bit_or("bit").alias("bits"))
        .where(F.col("bits") == _IMPS | _BIDS | _CLICKS | _FOLLOWED)
        .select("dh", shift_hour(F.col("dh"), 1).alias("follow_hour"))
    )


def retained_hours(table: DataFrame, as_of: str, days: int = 8) -> DataFrame:
    return hours_of(table.where(F.col("dh") >= _cutoff(as_of, days)))


def hours_to_load(source: DataFrame, loaded: DataFrame) -> DataFrame:
    return hours_of(source).join(hours_of(loaded), "dh", "left_anti")


def populated(hours: DataFrame, logs: Sequence[DataFrame]) -> DataFrame:
    """Those of a few planned hours that hold a row in every log.

    A partition may be there and empty. The planned hours, no more than a look-back
    has, become literals, so that only their partitions are looked into.
    """
    planned = sorted(row["dh"] for row in hours.select("dh").collect())
    found = [hours_of(in_hours(log, planned)) for log in logs]
    return reduce(lambda left, log: left.join(log, "dh", "left_semi"), found, hours)


def incremental_rows(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of the hours not loaded yet, ready for a dynamic partition overwrite.

    The missing hours are listed first, one short string per calendar hour, so
    that the scan of the source is given literals and prunes the others. Rows
    without an hour are in none and left out.
    """
    missing = [row["dh"] for row in hours_to_load(source, loaded).where("dh IS NOT NULL").collect()]
    return in_hours(source, sorted(missing))
