"""The hourly aggregates on arriving logs.

Impressions, bids and responses are streams of hourly rows. State is kept per auction
and hour: one row gathers the impressions and counts the bids, and only when its hour
is complete, and there are both, it goes on. The response window is the time range of
a stream-stream outer join: such a row waits for responses up to ``window_hours``
after its own hour, and no longer than the watermark allows, so that its state can be
dropped. An hour's groups are given out once, when no row of them can change any more;
the rows are those of the batch job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from auctionlens.functions.predicates import bid_filter, size_area
from auctionlens.functions.timeparts import with_partition_parts
from auctionlens.operators.hourly import JOBS, HourlyJob, responses_for
from auctionlens.sources.ledger import HourLedger
from auctionlens.sources.sinks import overwrite_partitions

#: How much later than the newest hour a row may arrive and still count.
ALLOWED_DELAY = "1 hour"


def stream_log(
    spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The rows of the files arriving in ``folder``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def hour_start(hour: Column) -> Column:
    """The instant of an hour string, read as UTC whatever the session's time zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = F.concat(hour, F.lit(":00:00")).cast("timestamp_ntz")
    return F.timestamp_seconds(F.timestamp_diff("SECOND", epoch, moment))


def _timed(log: DataFrame, name: str, delay: str) -> DataFrame:
    return log.withColumn(name, hour_start(F.col("dh"))).withWatermark(name, delay)


def _gathered_bids(job: HourlyJob) -> list[Column]:
    """The bids of an auction and hour, as in ``attribution.count_bids``: their number, and each with its bid keys if the job has any."""
    if job.bid_keys:
        bids = (F.collect_set if job.bid_once else F.collect_list)("bid")
        return [bids.alias("bids"), F.size(bids).cast("bigint").alias("n_bids")]
    n = F.count("bid")
    return [(F.least(n, F.lit(1).cast("bigint")) if job.bid_once else n).alias("n_bids")]


def streamed_aggregate(
    name: str,
    imps: DataFrame,
    bids: DataFrame,
    responses: DataFrame,
    campaigns: DataFrame | None = None,
    delay: str = ALLOWED_DELAY,
) -> DataFrame:
    """``dh`` + keys + two measures of the job ``name``, in append mode.

    A row that comes later than ``delay`` after the newest hour of the slowest log
    may be dropped. ``campaigns`` is a stored table.
    """
    job = JOBS[name]
    wanted = _timed(imps, "at", delay).where(job.imp_filter())
    if "size" in job.keys:
        wanted = wanted.withColumn("size", size_area())
    own = [k for k in job.keys if k not in job.bid_keys]
    wanted = wanted.select("auction_id_64", "at", F.struct("dh", *own).alias("imp"))
    if job.chosen_campaigns:
        if campaigns is None:
            raise ValueError("this job needs the chosen campaigns")
        bought = bids.where(F.col("payment_type").isin(list(job.payments)))
        bought = bought.join(campaigns.select("campaign_id"), "campaign_id", "left_semi")
    else:
        bought = bids.where(bid_filter(job.payments))
    bought = _timed(bought, "at", delay).select("auction_id_64", "at", F.struct(F.lit(1), *job.bid_keys).alias("bid"))
    auctions = (
        wanted.unionByName(bought, allowMissingColumns=True)
        .where("auction_id_64 IS NOT NULL AND at IS NOT NULL")
        .repartition("auction_id_64", "at")  # an auction's rows are gathered once, not by each file first
        .groupBy("auction_id_64", "at")
        .agg(F.collect_list("imp").alias("imps"), *_gathered_bids(job))
        .where((F.size("imps") > 0) & (F.col("n_bids") > 0))
    )
    late = _timed(responses_for(job, responses), "response_at", delay).select(
        F.col("auction_id_64").alias("response_id"), "response_at"
    )
    window = F.expr(f"INTERVAL {job.window_hours} HOURS")
    in_time = (F.col("response_at") >= F.col("at")) & (F.col("response_at") <= F.col("at") + window)
    matched = auctions.join(late, (F.col("auction_id_64") == F.col("response_id")) & in_time, "left")
    if job.bid_keys:
        matched = matched.withColumn("bid", F.explode("bids")).withColumn("n_bids", F.lit(1).cast("bigint"))
    matched = matched.withColumn("imp", F.explode("imps"))
    answered = F.when(F.col("response_id").isNotNull(), F.col("n_bids"))
    if job.zero_fill:
        answered = F.coalesce(answered, F.lit(0).cast("bigint"))
    keys = [F.col(f"{'bid' if k in job.bid_keys else 'imp'}.{k}").alias(k) for k in job.keys]
    return (
        matched.select("at", "imp.dh", *keys, "n_bids", answered.alias("answered"))
        .groupBy(F.window("at", "1 hour"), "dh", *job.keys)
        .agg(F.sum("n_bids").alias("imps"), F.sum("answered").alias(job.measure))
        .drop("window")
    )


def write_batch(rows: DataFrame, batch: int, path: str, ledger: HourLedger, deep: bool = False) -> None:
    """One batch into its own part of the hour partitions it holds rows of, then into the journal.

    A batch that is run again replaces what it wrote before; one that is in the
    journal already is skipped.
    """
    if ledger.has_batch(batch):
        return
    parts = ("dy", "dm", "dd") if deep else ("dd",)
    stamped = with_partition_parts(rows, parts).withColumn("batch", F.lit(batch).cast("bigint"))
    overwrite_partitions(stamped, path, (*parts, "dh", "batch"))
    schema = StructType([*rows.schema, *[f for f in stamped.schema if f.name in (*parts, "batch")]])
    written = rows.sparkSession.read.schema(schema).parquet(path).where(F.col("batch") == batch)
    ledger.commit(written.groupBy("dh").agg(F.count(F.lit(1)).alias("n_rows")), batch)


def start_hours(
    rows: DataFrame,
    path: str,
    ledger_path: str,
    checkpoint: str,
    deep: bool = False,
    once: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Write a stream of rows with ``dh`` into hour partitions; ``once`` works off what is there and stops.

    Readers take the rows of journaled batches, by ``ledger.committed``.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, HourLedger(batch.sparkSession, ledger_path), deep)

    trigger = {"availableNow": True} if once else {"processingTime": every}
    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    )
