"""The live tweet filter: the batch transforms on a stream of tweet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from auctionlens.operators.tweets import tweet_select, tweet_track
from auctionlens.sources.readers import parse_tweets


def stream_tweets(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Nested tweets of the line-JSON files arriving in ``folder``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_tweets(reader.text(folder))


def selected(tweets: DataFrame, keywords: Sequence[str] | str | None = None) -> DataFrame:
    """English tweets, narrowed to the tracked keywords when there are any."""
    return tweet_select(tweets if keywords is None else tweet_track(tweets, keywords))


def start_selection(
    tweets: DataFrame,
    out: str,
    checkpoint: str,
    keywords: Sequence[str] | str | None = None,
    once: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Append the selection to a parquet folder; ``once`` works off what is there and stops."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        selected(tweets, keywords)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )
