"""Offers in test that do not receive impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.functions.predicates import learning, performance
from auctionlens.functions.timeparts import looking_back
from auctionlens.operators.lookups import country_groups, site_bucket_map, size_bucket_map
from auctionlens.operators.reporting import of_sites

SELL_SIDE = ["bucket_id", "country_group_id", "creative_size_bucket_id"]


def learn_imps_by_offer(
    fact: DataFrame, sites: DataFrame, site: DataFrame, country: DataFrame, sizes: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Managed learn impressions per line item and sell-side key.

    The fact is aggregated on its raw keys before the dimensions are joined, so
    the joins see a reduced table.
    """
    raw_keys = ["campaign_group_id", "site_id", "geo_country", "width", "height"]
    recent = fact.where(
        looking_back("ymd", as_of, days, strict=True) & (F.col("imp_type") == 5) & performance() & learning()
    )
    nodes = of_sites(recent.groupBy(*raw_keys).agg(F.sum("imps").alias("imps")), sites)
    return (
        nodes.join(country_groups(country), "geo_country")
        .join(site_bucket_map(site), "site_id")
        .join(size_bucket_map(sizes), ["width", "height"])
        .groupBy("campaign_group_id", *SELL_SIDE)
        .agg(F.sum("imps").alias("imps"))
    )


def managed_test_offers(offers: DataFrame, sites: DataFrame, site: DataFrame, campaign_group: DataFrame) -> DataFrame:
    """Live offers in the test state whose line item belongs to the offering member.

    Identical offers are folded into one counted row before the joins.
    """
    buckets = site_bucket_map(site).join(sites.select("site_id"), "site_id", "left_semi")
    testing = (
        offers.where("deleted = 0 AND opt_state = 0")
        .groupBy("campaign_group_id", "bucket_member_id", *SELL_SIDE)
        .agg(F.count(F.lit(1)).alias("offers"))
        .join(buckets.select("bucket_id"), "bucket_id", "left_semi")
    )
    owner = campaign_group.select(
        F.col("id").alias("campaign_group_id"), F.col("member_id").alias("bucket_member_id")
    )
    return testing.join(owner, ["campaign_group_id", "bucket_member_id"])


def clogged_nodes(
    fact: DataFrame,
    sites: DataFrame,
    offers: DataFrame,
    site: DataFrame,
    country: DataFrame,
    sizes: DataFrame,
    campaign_group: DataFrame,
    as_of: str,
    days: int,
) -> DataFrame:
    """Per sell-side key: offers in test, those with impressions, and the difference."""
    served = learn_imps_by_offer(fact, sites, site, country, sizes, as_of, days)
    offered = managed_test_offers(offers, sites, site, campaign_group)
    with_imps = F.coalesce(F.col("imps"), F.lit(0)) > 0
    return (
        offered.join(served, ["campaign_group_id", *SELL_SIDE], "left")
        .groupBy(*SELL_SIDE)
        .agg(
            F.sum(F.when(F.col("campaign_group_id") > 0, F.col("offers")).otherwise(0)).alias("number_of_offers"),
            F.sum(F.when(with_imps, F.col("offers")).otherwise(0)).alias("number_of_offers_w_imps"),
        )
        .withColumn("clogged_offers", F.col("number_of_offers") - F.col("number_of_offers_w_imps"))
    )


def clog_order() -> list[Column]:
    """The largest difference first."""
    return [F.desc("clogged_offers"), *map(F.col, SELL_SIDE)]


def most_clogged_first(report: DataFrame) -> DataFrame:
    return report.orderBy(*clog_order())
