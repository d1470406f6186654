"""Hierarchical inventory buckets: building, applying, updating and scoring them.

A bucket level is a depth k: its rows are keyed by ``features[k:]`` and hold
NULL in the dropped leading features. All levels live in one DataFrame with a
``level`` column, so every operator is one plan whose length grows with the
number of features, and rows settled early travel along without being
recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import BUCKET_DELETE_BELOW, BUCKET_GROW_ABOVE, BUCKET_MIN_IMPS
from auctionlens.functions.measures import (
    bernoulli_variance, negative_concentration, split_entropy, truncated,
)
from auctionlens.functions.predicates import with_keys

HISTOGRAM_BINS = 30


def _sums() -> list[Column]:
    return [F.sum("imps").alias("imps"), F.sum("clicks").alias("clicks")]


def _settle(df: DataFrame, k: int, features: Sequence[str], settled: Column) -> DataFrame:
    """Give open rows that pass ``settled`` the level k; the others lose feature k."""
    level = F.when(F.col("level").isNotNull(), F.col("level")).when(settled, F.lit(k))
    kept = F.when(F.col("next_level").isNotNull(), F.col(features[k]))
    return df.withColumn("next_level", level).withColumn(features[k], kept).drop("level").withColumnRenamed(
        "next_level", "level"
    )


def bucketize(df: DataFrame, features: Sequence[str], min_imps: float = BUCKET_MIN_IMPS) -> DataFrame:
    """Groups of at least ``min_imps`` become buckets, level by level; the rest is one last row.

    Level k groups what is left by ``features[k:]``. The last level is a single
    row for the remainder, which counts one impression more than it has and is
    there even when nothing is left.
    """
    n = len(features)
    state = (
        with_keys(df, features)
        .groupBy(*features)
        .agg(*_sums())
        .withColumn("level", F.lit(None).cast("int"))
    )
    for k in range(n):
        if k:
            state = state.groupBy("level", *features).agg(*_sums())
        state = _settle(state, k, features, F.col("imps") >= min_imps)
    nothing = df.sparkSession.range(1).select(
        *[F.lit(None).cast(state.schema[f].dataType).alias(f) for f in features],
        F.lit(None).cast("int").alias("level"),
        *[F.lit(0).cast(state.schema[c].dataType).alias(c) for c in ("imps", "clicks")],
    )
    last = state.unionByName(nothing).withColumn("level", F.coalesce("level", F.lit(n)))
    rest = F.when(F.col("level") == n, 1).otherwise(0)
    return (
        last.groupBy("level", *features)
        .agg(*_sums())
        .withColumn("imps", F.col("imps") + rest)
        .select("level", *features, "imps", "clicks")
    )


def match_buckets(df: DataFrame, buckets: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of distinct keys with one flag ``in_bucket_k`` per level: whether a bucket of it holds the key.

    A row is offered with its key of every level, and one equi-join on level and
    masked key finds the buckets, which are read once.
    """
    n = len(features)
    keys = buckets.where(F.col("level") < n).select(
        F.col("level").alias("bucket_level"), *[F.col(f).alias(f"bucket_{f}") for f in features]
    ).distinct()
    types = {f: df.schema[f].dataType for f in features}
    offers = F.array(*[
        F.struct(
            F.lit(k).alias("level"),
            *[(F.col(f) if i >= k else F.lit(None).cast(types[f])).alias(f) for i, f in enumerate(features)],
        )
        for k in range(n)
    ])
    on = [F.col("offer.level") == F.col("bucket_level")]
    on += [F.col(f"offer.{f}").eqNullSafe(F.col(f"bucket_{f}")) for f in features]
    offered = df.select(*df.columns, F.explode(offers).alias("offer")).join(keys, on, "left")
    flags = [F.max(F.coalesce(F.col("bucket_level") == k, F.lit(False))).alias(f"in_bucket_{k}") for k in range(n)]
    return offered.groupBy(*df.columns).agg(*flags)


def assign_levels(df: DataFrame, buckets: DataFrame, features: Sequence[str]) -> DataFrame:
    """``level`` of the first bucket level holding each row's key, NULL when none does.

    A row's level depends on its own key only, so the levels need no
    aggregation in between.
    """
    first = F.coalesce(*[F.when(F.col(f"in_bucket_{k}"), F.lit(k)) for k in range(len(features))])
    return match_buckets(df, buckets, features).select(*df.columns, first.alias("level"))


def _mask(features: Sequence[str]) -> list[Column]:
    return [F.when(F.col("level") <= i, F.col(f)).alias(f) for i, f in enumerate(features)]


def bucket_perf(df: DataFrame, buckets: DataFrame, features: Sequence[str]) -> DataFrame:
    """Other data measured on existing bucket keys; what no bucket holds is dropped."""
    base = with_keys(df, features).groupBy(*features).agg(*_sums())
    assigned = assign_levels(base, buckets, features).where("level IS NOT NULL")
    return (
        assigned.select("level", *_mask(features), "imps", "clicks").groupBy("level", *features).agg(*_sums())
    )


def bucket_perf_campaign(df: DataFrame, buckets: DataFrame, features: Sequence[str]) -> DataFrame:
    """``bucket_perf`` per campaign, with the remainder of each campaign as the last level.

    Levels are found for the different keys, not for each campaign of a key. The groups,
    summed up first so that no hot key gathers rows, meet the level of their key; what
    keeps all its features is settled there, and only what loses some is combined anew
    over the shorter keys.
    """
    keys = [*features, "campaign_id"]
    known = with_keys(df, keys)
    base = known.groupBy(*keys).agg(*_sums())
    found = assign_levels(known.select(*features).distinct(), buckets, features).withColumn(
        "level", F.coalesce("level", F.lit(len(features)))
    )
    placed = base.join(found, list(features))
    whole = placed.where("level = 0").select("level", *keys, "imps", "clicks")
    rest = placed.where("level > 0").select("level", *_mask(features), "campaign_id", "imps", "clicks")
    return whole.unionByName(rest.groupBy("level", *keys).agg(*_sums()))


def bucket_update(
    df: DataFrame,
    buckets: DataFrame,
    features: Sequence[str],
    delete_below: float = BUCKET_DELETE_BELOW,
    grow_above: float = BUCKET_GROW_ABOVE,
) -> DataFrame:
    """Buckets that became too small (``delete``) and unmatched groups grown large (``grow``).

    Grown groups leave the remainder; buckets that stay as they are need no row.
    """
    base = with_keys(df, features).groupBy(*features).agg(*_sums())
    state = (
        match_buckets(base, buckets, features)
        .withColumn("level", F.lit(None).cast("int"))
        .withColumn("action", F.lit(None).cast("string"))
    )
    for k in range(len(features)):
        if k:
            # Open rows of one group share what is left of the key, and so its flags.
            flags = [F.max(f"in_bucket_{j}").alias(f"in_bucket_{j}") for j in range(k, len(features))]
            state = state.groupBy("level", "action", *features).agg(*_sums(), *flags)
        matched = F.col(f"in_bucket_{k}")
        still_open = F.col("level").isNull()
        action = (
            F.when(still_open & matched & (F.col("imps") < delete_below), "delete")
            .when(still_open & ~matched & (F.col("imps") > grow_above), "grow")
            .otherwise(F.col("action"))
        )
        unchanged_bucket = still_open & matched & F.col("action").isNull()
        state = state.withColumn("action", action).where(~unchanged_bucket)
        state = _settle(state, k, features, F.col("action").isNotNull())
    return state.where("action IS NOT NULL").select("level", *features, "imps", "clicks", "action")


def bucket_variance(buckets: DataFrame) -> DataFrame:
    """One row: both variance measures over rows that are one bucket each."""
    imps, clicks = F.col("imps"), F.col("clicks")
    return buckets.agg(
        F.sum(bernoulli_variance(clicks, imps)).alias("variance"),
        F.sum(negative_concentration(clicks, imps)).alias("variance_2"),
    )


def bucket_entropy(buckets: DataFrame) -> DataFrame:
    """One row: entropy over rows that are one bucket each, also truncated."""
    entropy = F.sum(split_entropy(F.col("imps"), F.col("clicks")))
    return buckets.agg(entropy.alias("entropy"), truncated(entropy).alias("entropy_int"))


def level_scores(buckets: DataFrame) -> DataFrame:
    """Entropy, concentration, size and volume of each level."""
    imps, clicks = F.col("imps"), F.col("clicks")
    return buckets.groupBy("level").agg(
        F.sum(split_entropy(imps, clicks)).alias("entropy"),
        F.sum(negative_concentration(clicks, imps)).alias("variance"),
        F.count(F.lit(1)).alias("buckets"),
        F.sum("imps").alias("imps"),
        F.sum("clicks").alias("clicks"),
    )


def bucket_summary(buckets: DataFrame) -> DataFrame:
    """One row: variance, share of the raw entropy removed, bucket count and volume.

    Entropy is truncated per level before it is added up.
    """
    total = level_scores(buckets).agg(
        F.sum("variance").alias("total_var"),
        F.sum(truncated(F.col("entropy"))).alias("total_entropy"),
        F.sum("buckets").alias("num_buckets"),
        F.sum("imps").alias("imps"),
        F.sum("clicks").alias("clicks"),
    )
    removed = 1 - F.try_divide(F.col("total_entropy").cast("double"), split_entropy(F.col("imps"), F.col("clicks")))
    return total.select("total_var", removed.alias("info_gain"), "num_buckets", "imps", "clicks")


def campaign_gain(per_campaign: DataFrame, raw_entropy: float | None = None) -> DataFrame:
    """One row: variance, conditional entropy and information gain of ``bucket_perf_campaign``.

    The gain is relative to ``raw_entropy``, by default that of the data itself.
    """
    total = level_scores(per_campaign).agg(
        F.sum("variance").alias("total_var"),
        F.sum(truncated(F.col("entropy"))).alias("conditional_entropy"),
        F.sum("imps").alias("imps"),
        F.sum("clicks").alias("clicks"),
    )
    raw = F.lit(raw_entropy) if raw_entropy is not None else split_entropy(F.col("imps"), F.col("clicks"))
    gain = 1 - F.try_divide(F.col("conditional_entropy").cast("double"), raw)
    return total.select("total_var", "conditional_entropy", gain.alias("info_gain"))


def contingency(df: DataFrame, key: str, flag: Column, weight: str = "imps") -> DataFrame:
    """Weight per category with and without the flag."""
    w = F.col(weight)
    return (
        with_keys(df, [key])
        .groupBy(key)
        .agg(
            F.sum(F.when(flag, w).otherwise(0)).alias("weight_true"),
            F.sum(F.when(~flag, w).otherwise(0)).alias("weight_false"),
        )
    )


def _key_buckets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(*_sums()).where("imps >= 1")


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how well a key set separates clicks."""
    imps, clicks = F.col("imps"), F.col("clicks")
    entropy = F.sum(split_entropy(imps, clicks))
    return _key_buckets(df, keys).agg(
        F.lit("_".join(keys)).alias("keys"),
        F.count(F.lit(1)).alias("buckets"),
        F.sum(bernoulli_variance(clicks, imps)).alias("variance"),
        F.sum(negative_concentration(clicks, imps)).alias("variance_2"),
        entropy.alias("entropy"),
        truncated(entropy).alias("entropy_int"),
    )


def key_report_histogram(df: DataFrame, keys: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Percent of the key groups per bin of log10 click rate and log10 impressions."""
    rate = F.col("clicks").cast("double") / F.col("imps").cast("double")
    points = _key_buckets(df, keys).select(
        F.explode(
            F.array(
                F.struct(F.lit("log_ctr").alias("metric"), F.round(F.log10(rate + 1e-6), 6).alias("x")),
                F.struct(F.lit("log_imps").alias("metric"), F.round(F.log10(F.col("imps")), 6).alias("x")),
            )
        ).alias("p")
    ).select("p.*")
    ends = points.groupBy("metric").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        "metric",
        "n",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    # Rounded, so that a point on a bin edge falls on the same side everywhere.
    offset = (F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))
    position = F.floor(F.round(offset, 6)).cast("int")
    # ``ends`` has two rows, one per metric.
    counted = (
        points.join(F.broadcast(ends), "metric")
        .groupBy("metric", F.least(position, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("groups"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, ["metric", "bin"], "left").select(
        "metric",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_start"),
        (F.coalesce("groups", F.lit(0)) * F.lit(100.0) / F.col("n")).alias("percent"),
    )
