"""Readers for hourly tables, snapshots, text exports, lexicons and tweets."""

from __future__ import annotations

import contextlib
import hashlib
import io
import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auctionlens.schemas import LEXICON, TWEET


def read_hourly(
    spark: SparkSession, path: str, schema: StructType, hours: Sequence[str] | None = None
) -> DataFrame:
    """An hourly parquet table; listed hours become a partition filter.

    The schema is given, since hour strings must not be guessed to be times.
    """
    table = spark.read.schema(schema).parquet(path)
    return table if hours is None else table.where(F.col("dh").isin(list(hours)))


def partition_hours(spark: SparkSession, table: str) -> DataFrame:
    """Hours of a partitioned catalog table, from its partition names only."""
    names = spark.sql(f"SHOW PARTITIONS {table}")
    return names.select(F.right("partition", F.lit(13)).alias("dh")).distinct()


def listed_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hours of an hourly table in a folder, from the names of its files; nothing is read from them.

    A partition without a data file has no hour here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    hour = F.regexp_extract(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/dh=([^/]*)/", 1)
    return files.select(hour.alias("dh")).where("dh <> ''").distinct()


def read_snapshot(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str] | None = None,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
) -> DataFrame:
    """A warehouse table over JDBC, read in ``partitions`` ranges of ``split_on`` when given."""
    if partitions > 1 and not (split_on and bounds):
        raise ValueError("several partitions need split_on and bounds")
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(properties or {}))
    if split_on and bounds:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.load()


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """Tab-separated text as the warehouse exports it: a header line and NULL spelled out."""
    return spark.read.csv(path, sep="\t", header=header, schema=schema, nullValue="NULL", quote="")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LEXICON, quote="").where("term IS NOT NULL AND score IS NOT NULL")


def parse_tweets(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) to nested tweets; what is no JSON object with a text is skipped."""
    parsed = lines.select(F.from_json("value", TWEET, {"mode": "PERMISSIVE"}).alias("t"))
    return parsed.where("t IS NOT NULL AND t.text IS NOT NULL").select("t.*")


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return parse_tweets(spark.read.text(path))


def _plan_text(df: DataFrame) -> str:
    """The optimized plan as text, without the numbers that Spark gives to columns anew each time."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    optimized = out.getvalue().split("== Optimized Logical Plan ==")[-1].split("== Physical Plan ==")[0]
    return re.sub(r"#\d+L?|plan_id=\d+", "", optimized)


def fingerprint(df: DataFrame, inputs: Sequence[DataFrame], key: str = "") -> str:
    """Changes when the plan, its schema, the ``key`` or any file that the inputs are read from changes.

    Of files their names, sizes and times of change count, of which Spark hashes one
    row a file; an input that is in no files is hashed row by row.
    """
    parts = [key, _plan_text(df), df.schema.json()]
    for rows in inputs:
        try:
            about = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        except AnalysisException:
            about = rows
        hashed = F.xxhash64(*[F.col(f"`{c}`") for c in about.columns])
        parts.append(str(about.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(hashed.cast("decimal(38,0)"))).first()))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def read_through(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], inputs: Sequence[DataFrame] = (), key: str = ""
) -> DataFrame:
    """The stored result below ``path``, computed and written first when it is missing or unfinished.

    With ``inputs``, the rows that the result is computed from, it is kept under its
    fingerprint: another plan or a changed file gives another result, and an equal
    one is not computed again. Without, ``path`` itself is the result.
    """
    if inputs:
        path = f"{path.rstrip('/')}/{fingerprint(compute(), inputs, key)}"
    finished = f"{path.rstrip('/')}/_SUCCESS"
    try:
        spark.read.format("binaryFile").load(finished).schema  # fails if there is no such file
    except AnalysisException:
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
