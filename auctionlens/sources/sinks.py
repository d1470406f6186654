"""Partitioned writers. Every one of them may be repeated without changing the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auctionlens.functions.timeparts import with_partition_parts
from auctionlens.operators.hourly import FOUR_WAY, JOBS


def overwrite_partitions(
    df: DataFrame, path: str, by: tuple[str, ...], fmt: str = "parquet", **options: str
) -> None:
    """Replace only the partitions present in ``df``.

    The rebalance hint lets the runtime merge small partitions into one file
    and cut a large one into several, so a hot hour is not one task.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**options)
        .partitionBy(*by)
        .format(fmt)
        .save(path)
    )


def write_hours(df: DataFrame, path: str, deep: bool = False, compression: str = "snappy") -> None:
    """Overwrite ``(dd, dh)`` partitions, or ``(dy, dm, dd, dh)`` when ``deep``."""
    parts = ("dy", "dm", "dd") if deep else ("dd",)
    overwrite_partitions(with_partition_parts(df, parts), path, (*parts, "dh"), compression=compression)


def write_bucketed_hours(df: DataFrame, table: str, bucket_by: str, buckets: int) -> None:
    """Overwrite the hours of ``df`` in a bucketed catalog table; each hour has one sorted file a bucket."""
    spark = df.sparkSession
    columns = spark.table(table).columns
    parts = [p for p in ("dy", "dm", "dd") if p in columns]
    rows = with_partition_parts(df, parts).select(columns).repartition(buckets, bucket_by)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_report(df: DataFrame, path: str, *by: Column | str) -> None:
    """A report in the order of ``by``: files hold adjoining ranges, rows are sorted within, and ``place`` numbers them.

    The order is a column of the table, as readers take files in an order of their own.
    """
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A stored report in the order it was written in."""
    return spark.read.parquet(path).orderBy("place").drop("place")


def write_four_way(four_way: DataFrame, path: str) -> None:
    """All four targets in one write: ``target=.../dd=.../dh=...``."""
    overwrite_partitions(with_partition_parts(four_way, ("dd",)), path, ("target", "dd", "dh"))


def read_four_way(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored targets, each with its own columns only."""
    out = {}
    for target in FOUR_WAY:
        folder = f"{path}/target={target}"
        guessed = spark.read.parquet(folder).schema
        text = StructType([StructField(f.name, StringType()) if f.name in ("dd", "dh") else f for f in guessed])
        out[target] = spark.read.schema(text).parquet(folder).select("dh", *JOBS[target].keys, "imps", "clicks")
    return out


def write_days(df: DataFrame, path: str, day: str = "ymd") -> None:
    """Daily table keyed by day: a repeated day replaces itself instead of failing on its key."""
    overwrite_partitions(df, path, (day,))


def write_meta_tsv(df: DataFrame, path: str, hour: str) -> None:
    """Header-less TSV in the time partition of ``hour``."""
    stamped = with_partition_parts(df.withColumn("dh", F.lit(hour)))
    overwrite_partitions(stamped, path, ("dy", "dm", "dd", "dh"), "csv", sep="\t", header="false", emptyValue="")


def export_day(df: DataFrame, path: str) -> None:
    """Hourly text files of one day, one folder per hour of the clock."""
    overwrite_partitions(
        df.withColumn("hh", F.col("dh").substr(12, 2)).drop("dh"), path, ("hh",), "csv", sep="\t", header="true"
    )


def drop_old_hours(spark: SparkSession, table: str, cutoff: str) -> list[str]:
    """Drop the partitions of a catalog table whose hour lies before ``cutoff``; returns the hours.

    Only partition names are listed, no data is read.
    """
    specs = [dict(p.split("=", 1) for p in r.partition.split("/")) for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = [s for s in specs if s["dh"] < cutoff]
    if old:
        listed = ", ".join("PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in s.items()) + ")" for s in old)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")
    return sorted(s["dh"] for s in old)
