"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

SHUFFLE_PARTITION_BYTES = 128 << 20


def initial_shuffle_partitions(shuffled_bytes: int) -> int:
    """Enough partitions to keep each near 128 MB; the runtime merges what turns out small."""
    return max(200, -(-shuffled_bytes // SHUFFLE_PARTITION_BYTES))


def build_session(
    app: str = "auctionlens", master: str | None = None, shuffled_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with run-time planning on; ``shuffled_bytes`` is the largest expected shuffle."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Pages and documents are long rows: fewer of them per Arrow batch.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    if shuffled_bytes:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_shuffle_partitions(shuffled_bytes))
        )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
