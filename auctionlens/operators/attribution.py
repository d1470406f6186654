"""Impressions matched to bids and to late responses.

The logical joins are impressions x bids x responses on the auction, and
duplicates multiply. Carrying out that product row by row would square a hot
auction, so bids and responses are first reduced to one counted row per auction
and hour (map-side combine absorbs the duplicates), and the multiplicities are
applied as weights in the final aggregate:

    rows of an impression = n_bids * max(1, n_responses)
    responses             = n_bids * n_responses       (NULL when there are none)

The wide impression log is shuffled once, for its join to that counted side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.timeparts import add_hours, shift_hour

AUCTION = ["auction_id_64", "dh"]


def in_hours(df: DataFrame, hours: Sequence[str] | None) -> DataFrame:
    """Literal hour list, so that the scan prunes partitions; None keeps all hours."""
    return df if hours is None else df.where(F.col("dh").isin(list(hours)))


def count_bids(bids: DataFrame, keys: Sequence[str] = (), once: bool = False) -> DataFrame:
    """One row per auction, hour and extra bid key with its number of bids.

    ``once`` counts an auction a single time however many bids it has, which is
    what a semi join asks for.
    """
    by = [*AUCTION, *keys]
    if once:
        return bids.select(*by).distinct().withColumn("n_bids", F.lit(1).cast("bigint"))
    return bids.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bids"))


def count_responses(
    responses: DataFrame, window_hours: int, hours: Sequence[str] | None = None
) -> DataFrame:
    """Responses per auction and hour of the response, from the hours that are in time for any of ``hours``."""
    if hours is not None:
        in_time = {add_hours(hour, late) for hour in hours for late in range(window_hours + 1)}
        responses = in_hours(responses, sorted(in_time))
    return responses.groupBy("auction_id_64", F.col("dh").alias("response_dh")).agg(F.count(F.lit(1)).alias("n"))


def with_responses(
    bid_counts: DataFrame, response_counts: DataFrame, window_hours: int, dedup: bool = False
) -> DataFrame:
    """Counted bids with the number of responses in time for their hour, NULL without any.

    Both sides are counted, so an auction has at most one row per hour (and bid
    key) here, however hot it is.
    """
    keys = bid_counts.columns
    timed = bid_counts.withColumn("until", shift_hour(F.col("dh"), window_hours))
    late = response_counts.withColumnRenamed("auction_id_64", "response_id")
    in_time = (F.col("auction_id_64") == F.col("response_id")) & F.col("response_dh").between(
        F.col("dh"), F.col("until")
    )
    total = F.sum("n")
    return (
        timed.join(late, in_time, "left")
        .groupBy(*keys)
        .agg((F.when(total > 0, F.lit(1).cast("bigint")) if dedup else total).alias("n_responses"))
    )


def attribute(imps: DataFrame, counted: DataFrame, colocated: bool = False) -> DataFrame:
    """Impressions with a bid, each with its ``n_bids`` and ``n_responses``.

    ``colocated`` is for impressions stored in buckets of their auction: they stay
    where they are, and the counted rows come to them.
    """
    if colocated:
        # With the hour as a second equality the bucketing on the auction alone would not do.
        side = counted.withColumnsRenamed({"auction_id_64": "bid_auction", "dh": "bid_dh"})
        same_hour = F.col("dh").between(F.col("bid_dh"), F.col("bid_dh"))
        return imps.join(side, (F.col("auction_id_64") == F.col("bid_auction")) & same_hour, "inner")
    # The counted side may be partitioned by auction already. Joining on one
    # more key gives both inputs a shuffle of their own, and only such joins can
    # have a hot auction's impressions split over several tasks at run time.
    spread = F.xxhash64(*AUCTION)
    return imps.withColumn("pair_key", spread).join(
        counted.withColumn("pair_key", spread), ["pair_key", *AUCTION], "inner"
    )


def attributed_rows() -> Column:
    return F.sum(F.col("n_bids") * F.coalesce(F.col("n_responses"), F.lit(1))).alias("imps")


def attributed_responses(name: str, zero_fill: bool = False) -> Column:
    total = F.col("n_bids") * F.col("n_responses")
    return F.sum(F.coalesce(total, F.lit(0)) if zero_fill else total).alias(name)
