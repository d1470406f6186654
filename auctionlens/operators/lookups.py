"""Site, country, size and code dimensions and the mappings between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import (
    HOUSE_MEMBER, IMP_TYPE_NAMES, OPT_STATE_NAMES, PREDICT_TYPE_NAMES, REVENUE_TYPE_NAMES,
)


def _programme(site: DataFrame, marketplace: DataFrame) -> DataFrame:
    listed = marketplace.where("deleted = 0 AND performance = 1").select(
        "site_id", "created_on", F.col("last_modified").substr(1, 10).alias("last_modified")
    )
    live = site.where("deleted = 0").select(F.col("id").alias("site_id"), "member_id")
    return listed.join(live, "site_id").select("member_id", "site_id", "created_on", "last_modified")


def programme_sites(site: DataFrame, marketplace: DataFrame) -> DataFrame:
    """Live flagged sites, the house member left out."""
    return _programme(site, marketplace).where(F.col("member_id") != HOUSE_MEMBER)


def newest_first(sites: DataFrame) -> DataFrame:
    return sites.orderBy(F.desc("created_on"), "site_id")


def programme_sites_of_member(site: DataFrame, marketplace: DataFrame, member_id: int, since: str) -> DataFrame:
    return _programme(site, marketplace).where((F.col("member_id") == member_id) & (F.col("created_on") >= since))


def site_bucket_map(site: DataFrame) -> DataFrame:
    """Live active site -> inventory bucket."""
    return site.where("deleted = 0 AND state = 'active'").select(
        F.col("id").alias("site_id"), F.col("managed_bucket_id").alias("bucket_id")
    )


def sites_of_buckets(site: DataFrame, marketplace: DataFrame, buckets: DataFrame) -> DataFrame:
    """Performance sites of the given buckets (a DataFrame with ``bucket_id``)."""
    flagged = marketplace.where("performance = 1").select("site_id")
    return (
        site.where("deleted = 0")
        .select(F.col("id").alias("site_id"), F.col("managed_bucket_id").alias("bucket_id"))
        .join(buckets.select("bucket_id"), "bucket_id", "left_semi")
        .join(flagged, "site_id")
        .select("site_id", "bucket_id")
    )


def site_closure(site: DataFrame, marketplace: DataFrame, sites: DataFrame) -> DataFrame:
    """All sites sharing a bucket with the given sites."""
    buckets = site_bucket_map(site).join(sites.select("site_id"), "site_id", "left_semi")
    return sites_of_buckets(site, marketplace, buckets)


def sites_of_publishers(site: DataFrame, publishers: DataFrame) -> DataFrame:
    return site.join(publishers.select("publisher_id"), "publisher_id", "left_semi").select("id").distinct()


def size_bucket_map(sizes: DataFrame) -> DataFrame:
    return sizes.where("deleted = 0 AND active = 1").select(
        F.col("id").alias("creative_size_bucket_id"), "width", "height"
    )


def country_groups(country: DataFrame) -> DataFrame:
    """Country code -> group; the latest entry of a repeated code holds."""
    return country.groupBy(F.col("code").alias("geo_country")).agg(
        F.max_by("country_group_id", "id").alias("country_group_id")
    )


def with_country_group(df: DataFrame, country: DataFrame, upper: bool = False) -> DataFrame:
    """Adds ``country_group_id`` as text, '' for an unknown code."""
    groups = country_groups(country).select(
        F.col("geo_country").alias("group_code"),
        F.col("country_group_id").cast("string").alias("country_group_id"),
    )
    code = F.upper("geo_country") if upper else F.col("geo_country")
    return (
        df.join(groups, code == groups["group_code"], "left")
        .drop("group_code")
        .withColumn("country_group_id", F.coalesce("country_group_id", F.lit("")))
    )


def map_sell_side_keys(data: DataFrame, site: DataFrame, country: DataFrame, sizes: DataFrame) -> DataFrame:
    """Site, country and size of each row -> bucket, country group and size bucket (default 1)."""
    live_countries = country.where("deleted = 0").select(F.col("code").alias("geo_country"), "country_group_id")
    return (
        data.join(site_bucket_map(site), "site_id", "left")
        .join(live_countries, "geo_country", "left")
        .join(size_bucket_map(sizes), ["width", "height"], "left")
        .withColumn("creative_size_bucket_id", F.coalesce("creative_size_bucket_id", F.lit(1)))
    )


def _labels(df: DataFrame, key: str, schema: str, rows: list[tuple]) -> DataFrame:
    """Left join to a fixed label table of at most a dozen rows."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), key, "left")


def with_imp_type_name(df: DataFrame) -> DataFrame:
    return _labels(df, "imp_type", "imp_type int, imp_type_name string", list(IMP_TYPE_NAMES.items()))


def with_revenue_type_name(df: DataFrame) -> DataFrame:
    return _labels(df, "revenue_type", "revenue_type int, rev_type_name string", list(REVENUE_TYPE_NAMES.items()))


def with_predict_type_name(df: DataFrame) -> DataFrame:
    rows = [(code, name, bid) for code, (name, bid) in PREDICT_TYPE_NAMES.items()]
    return _labels(df, "predict_type_rev", "predict_type_rev int, predict_type_name string, bid_type string", rows)


def with_opt_state_name(df: DataFrame) -> DataFrame:
    return _labels(df, "opt_state", "opt_state int, opt_state_nm string", list(OPT_STATE_NAMES.items()))
