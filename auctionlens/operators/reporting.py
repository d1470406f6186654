"""Conditional sums and ratios over the advertiser/publisher fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import SITE_MIN_PERF_IMPS, UNREPORTED_IMP_TYPES
from auctionlens.functions.measures import per_mille, ratio
from auctionlens.functions.predicates import in_countries, learning, performance, sized, with_keys
from auctionlens.functions.timeparts import looking_back, time_grain

PSEUDO_NODE = (
    "seller_member_id", "site_id", "geo_country", "width", "height",
    "campaign_group_id", "campaign_id", "creative_id", "tag_id",
)


def _classes() -> dict[str, Column]:
    kept, resold = F.col("imp_type") == 5, F.col("imp_type") == 6
    perf = performance()
    learn = perf & learning()
    return {
        "perf": perf,
        "perf_managed": perf & kept,
        "perf_xnet": perf & resold,
        "learn": learn & F.col("imp_type").isin(5, 6),
        "learn_managed": learn & kept,
        "learn_xnet": learn & resold,
    }


def class_sum(cls: str | None, value: Column) -> Column:
    """Sum of ``value`` over one class of rows (all rows when None)."""
    return F.sum(value if cls is None else F.when(_classes()[cls], value).otherwise(0))


def imps_sum(cls: str | None) -> Column:
    return class_sum(cls, F.col("imps")).cast("bigint")


def revenue_sum(cls: str | None) -> Column:
    """Booked plus reseller revenue; learn classes count booked revenue only."""
    booked = F.col("booked_revenue_dollars")
    learn = cls is not None and cls.startswith("learn")
    return class_sum(cls, booked if learn else booked + F.col("reseller_revenue"))


def reported(fact: DataFrame) -> DataFrame:
    return fact.where(~F.col("imp_type").isin(list(UNREPORTED_IMP_TYPES)))


def of_sites(report: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows of the given sites (a DataFrame with ``site_id``).

    Written after an aggregation on the site: a site list small enough to be
    broadcast is moved below it by the optimizer, and a long one meets reduced
    rows instead of the fact.
    """
    return report.join(sites.select("site_id"), "site_id", "left_semi")


def perf_data(fact: DataFrame, sites: DataFrame, as_of: str, lookback_days: int, hourly: bool = False) -> DataFrame:
    """Total, performance and learn volumes per time and pseudo node."""
    rows = reported(fact).where(looking_back("ymd", as_of, lookback_days))
    grain = time_grain(hourly)
    report = rows.groupBy(grain, *PSEUDO_NODE).agg(
        imps_sum(None).alias("total_imps"),
        imps_sum("perf").alias("perf_imps"),
        imps_sum("perf_managed").alias("perf_managed_imps"),
        imps_sum("perf_xnet").alias("perf_xnet_imps"),
        revenue_sum(None).alias("total_revenue"),
        revenue_sum("perf").alias("perf_revenue"),
        revenue_sum("perf_managed").alias("perf_managed_revenue"),
        revenue_sum("perf_xnet").alias("perf_xnet_revenue"),
        imps_sum("learn").alias("learn_imps"),
        revenue_sum("learn").alias("learn_rev"),
    )
    return of_sites(report, sites)


def perf_ratios(perf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Re-aggregate ``perf_data`` to any keys and derive the shares and rpm values."""
    summed = [
        "total_imps", "total_revenue", "learn_imps", "learn_rev", "perf_revenue", "perf_imps",
        "perf_managed_revenue", "perf_managed_imps", "perf_xnet_revenue", "perf_xnet_imps",
    ]
    sums = with_keys(perf, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in summed])
    c = F.col
    flat_imps = c("total_imps") - c("perf_imps")
    flat_revenue = c("total_revenue") - c("perf_revenue")
    return sums.withColumns(
        {
            "learn_pct": ratio(c("learn_imps"), c("total_imps")),
            "perf_rpm": per_mille(c("perf_revenue"), c("perf_imps")),
            "perf_managed_rpm": per_mille(c("perf_managed_revenue"), c("perf_managed_imps")),
            "perf_xnet_rpm": per_mille(c("perf_xnet_revenue"), c("perf_xnet_imps")),
            "flat_cpm_rpm": per_mille(flat_revenue, flat_imps),
            "flat_cpm_imps": flat_imps,
            "flat_cpm_revenue": flat_revenue,
            "learn_rpm": per_mille(c("learn_rev"), c("learn_imps")),
        }
    )


def site_daily_stats(fact: DataFrame, marketplace: DataFrame, min_perf_imps: int = SITE_MIN_PERF_IMPS) -> DataFrame:
    """Daily metrics of the sites with enough performance volume, programme sites flagged."""
    stats = (
        reported(fact)
        .groupBy("ymd", "seller_member_id", "site_id")
        .agg(
            imps_sum(None).alias("imps"),
            *[imps_sum(k).alias(f"{k}_imps") for k in _classes()],
            revenue_sum(None).alias("revenue"),
            *[revenue_sum(k).alias(f"{k}_rev") for k in _classes()],
        )
        .where(F.col("perf_imps") > min_perf_imps)
    )
    members = marketplace.where("deleted = 0 AND performance = 1")
    return flag_members(stats, members, "site_id", "in_programme")


def flag_members(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """0/1 column telling whether the row's key is among the members."""
    present = members.select(key).distinct().withColumn(flag, F.lit(1))
    return df.join(present, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def learn_share(
    fact: DataFrame,
    sites: DataFrame,
    as_of: str,
    lookback_days: int,
    width: int | str = "all",
    height: int | str = "all",
    countries: Sequence[str] | str = "all",
    hourly: bool = False,
) -> DataFrame:
    """Total and learn impressions by time, site, country and size, optionally narrowed."""
    rows = reported(fact).where(looking_back("ymd", as_of, lookback_days))
    for condition in (sized(width, height), in_countries(countries)):
        if condition is not None:
            rows = rows.where(condition)
    report = rows.groupBy(time_grain(hourly), "site_id", "geo_country", "width", "height").agg(
        imps_sum(None).alias("imps"), imps_sum("learn_managed").alias("learn_imps")
    )
    return of_sites(report, sites)


def learn_share_order(hourly: bool = False) -> list[Column]:
    """By time, largest first."""
    return [time_grain(hourly), F.desc("imps")]


def sorted_learn_share(report: DataFrame, hourly: bool = False) -> DataFrame:
    """The report as it is read."""
    return report.orderBy(*learn_share_order(hourly))
