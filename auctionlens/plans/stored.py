"""Runs through storage: logs are written as a warehouse holds them, then listed, loaded, streamed and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from auctionlens.operators import backfill, hourly
from auctionlens.plans import jobs
from auctionlens.schemas import BIDS, CLICKS, CONVERSIONS, HOURLY_TABLES, IMPS
from auctionlens.sources import sinks
from auctionlens.sources.catalog import Catalog, HourFolder
from auctionlens.sources.ledger import HourLedger, committed
from auctionlens.sources.readers import read_hourly, read_tsv
from auctionlens.streaming import hourly as streaming

LOGS = {"imps": IMPS, "bids": BIDS, "clicks": CLICKS, "conversions": CONVERSIONS}
#: The state of a stream is dealt to so many tasks for good, or to one for each core if these are more.
STATE_PARTITIONS = 8
#: A day of auctions in state outgrows the heap, so it is held on disk, with a bounded share of memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # Otherwise each of the many small stores of a short stream sets megabytes of disk aside.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder where all executors see it: below spark.checkpoint.dir, or else below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/_{label}-{uuid.uuid4().hex}"


def hour_folders(tables: Catalog, names: tuple[str, ...]) -> dict[str, HourFolder]:
    """The logs in hour partitions."""
    folder = scratch(tables.spark, "logs")
    for name in names:
        sinks.write_hours(tables[name], f"{folder}/{name}")
    return {name: HourFolder(f"{folder}/{name}", LOGS[name]) for name in names}


def ready_hours(tables: Catalog, as_of: str) -> DataFrame:
    """Planned from the names of stored partitions."""
    logs = Catalog(tables.spark, hour_folders(tables, ("imps", "bids", "clicks")))
    names = [logs.hours(n) for n in ("imps", "bids", "clicks")]
    return backfill.ready_hours(*names, tables.hours("aggregated_hours"), as_of)


def journaled_load(tables: Catalog, name: str, first: str) -> DataFrame:
    """An input loaded in two runs by the journal: the hours before ``first``, then all that are missing."""
    folder = scratch(tables.spark, "load")
    ledger, out = HourLedger(tables.spark, f"{folder}/journal"), f"{folder}/{name}"
    early = Catalog(tables.spark, {name: tables[name].where(F.col("dh") < first)})
    for part in (early, tables):
        jobs.load_missing_hours(part, name, ledger, out)
    return read_hourly(tables.spark, out, LOGS[name]).select(tables[name].columns)


def streamed(tables: Catalog, name: str, end: str, delay: str = "1 day") -> DataFrame:
    """An hourly aggregate from arriving files, all of them before ``end``, which closes the last hour."""
    spark = tables.spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism))
    for option, value in STATE_STORE.items():
        spark.conf.set(option, value)
    folder, job = scratch(spark, "stream"), hourly.JOBS[name]
    names = ("imps", "bids", job.response)
    # What passes every filter of the job: Spark moves them below the watermark.
    last = {
        "auction_id_64": -1, "supply_type": 0, "device_type": 0, "content_category_id": 1, "seller_member_id": 7,
        "buyer_member_id": 9, "payment_type": 0, "campaign_id": 1, "post_click_conv": 1, "dh": end,
    }
    for log in names:
        schema = LOGS[log]
        closing = tables.spark.range(1).select(*[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        tables[log].select(schema.names).unionByName(closing).write.parquet(f"{folder}/{log}")
    logs = [streaming.stream_log(spark, f"{folder}/{log}", LOGS[log]) for log in names]
    result = streaming.streamed_aggregate(name, *logs, delay=delay)
    paths = [f"{folder}/{x}" for x in ("out", "journal", "checkpoint")]
    streaming.start_hours(result, *paths, once=True).awaitTermination()
    schema = StructType([*result.schema, StructField("dd", StringType()), StructField("batch", LongType())])
    stored = tables.spark.read.schema(schema).parquet(paths[0])
    return committed(stored, HourLedger(tables.spark, paths[1])).select(result.columns)


def stored_hours(tables: Catalog, name: str, rows: DataFrame, deep: bool = False) -> DataFrame:
    """A stored table, written twice as a repeated run would."""
    path = scratch(tables.spark, name)
    for _ in range(2):
        sinks.write_hours(rows, path, deep)
    return read_hourly(tables.spark, path, HOURLY_TABLES[name]).select(rows.columns)


def stored_four_way(tables: Catalog, rows: DataFrame) -> DataFrame:
    """The four targets in one write, and back in the long form."""
    path = scratch(tables.spark, "four-way")
    sinks.write_four_way(rows, path)
    out = None
    for target, part in sinks.read_four_way(tables.spark, path).items():
        part = part.withColumn("target", F.lit(target))
        part = part.select(*[(F.col(f.name) if f.name in part.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
        out = part if out is None else out.unionByName(part)
    return out


def exported_day(tables: Catalog, stored: DataFrame, name: str, day: str) -> DataFrame:
    """The text files of a day, read back."""
    path = scratch(tables.spark, "export")
    jobs.export_day(stored, name, day, path)
    keys = hourly.EXPORTS[name][1]
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "imps bigint", "clicks bigint", "hh string"])
    hour = F.concat(F.lit(f"{day} "), F.col("hh")).alias("dh")
    return read_tsv(tables.spark, path, schema).select(hour, *keys, "imps", "clicks")


def stored_days(tables: Catalog, rows: DataFrame) -> DataFrame:
    """A daily table, written twice."""
    path = scratch(tables.spark, "days")
    for _ in range(2):
        sinks.write_days(rows, path)
    return tables.spark.read.schema(rows.schema).parquet(path).select(rows.columns)
