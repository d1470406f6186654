"""Named filters over impressions, bids and the reporting fact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import EXACT_SIZE_BUCKETS, EXCLUDED_MEMBERS, LARGE_AREA, MEDIUM_AREA


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all there; single IS NOT NULL tests reach the scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def not_excluded(seller: str = "seller_member_id", members: Sequence[int] = EXCLUDED_MEMBERS) -> Column:
    """NOT IN list: an impression without a seller is dropped too."""
    return ~F.col(seller).isin(list(members))


def resold() -> Column:
    return F.col("seller_member_id") != F.col("buyer_member_id")


def categorised() -> Column:
    return F.col("content_category_id") > 0


def supply_class(name: str) -> Column:
    supply = F.col("supply_type")
    classes = {
        "display": lambda: (supply < 2) & (F.col("device_type") == 0),
        "mobile_web": lambda: (supply < 2) & (F.col("device_id") != 0),
        "app": lambda: supply == 2,
        "social": lambda: supply == 3,
    }
    return classes[name]()


def bid_filter(payment_types: Sequence[int]) -> Column:
    return F.col("payment_type").isin(list(payment_types)) & (F.col("campaign_id") > 0)


def size_area(width: str = "width", height: str = "height") -> Column:
    return F.col(width) * F.col(height)


def size_bucket(area: Column) -> Column:
    """Creative area -> size bucket id; everything unnamed falls in bucket 1."""
    bucket = F.when(area > LARGE_AREA, 3).when(area > MEDIUM_AREA, 2)
    for size, bucket_id in EXACT_SIZE_BUCKETS.items():
        bucket = bucket.when(area == size, bucket_id)
    return bucket.otherwise(1)


def in_size_bucket(bucket: int) -> Column:
    """The rows of one size bucket as a predicate on width and height."""
    area = size_area()
    exact = {bucket_id: size for size, bucket_id in EXACT_SIZE_BUCKETS.items()}
    if bucket in exact:
        return area == exact[bucket]
    if bucket == 3:
        return area > LARGE_AREA
    if bucket == 2:
        return (area > MEDIUM_AREA) & (area <= LARGE_AREA)
    if bucket == 1:
        return (area <= MEDIUM_AREA) & ~area.isin(list(EXACT_SIZE_BUCKETS))
    if bucket == 0:
        return (F.col("width") == 0) & (F.col("height") == 0)
    raise ValueError(f"unknown size bucket {bucket}")


def sized(width: int | str = "all", height: int | str = "all") -> Column | None:
    """Optional size filter: both sides or neither."""
    if width == "all" and height == "all":
        return None
    if width == "all" or height == "all":
        raise ValueError("give both width and height, or neither")
    return (F.col("width") == width) & (F.col("height") == height)


def in_countries(countries: Sequence[str] | str = "all") -> Column | None:
    return None if countries == "all" else F.col("geo_country").isin(list(countries))


def performance() -> Column:
    return F.col("revenue_type").isin(3, 4)


def learning() -> Column:
    return F.col("predict_type_rev").isin(0, 1)


def trigger_of(value_type: Column) -> Column:
    """Payout value type -> trigger; other types have none."""
    return F.when(value_type == "pc_cpa", "click").when(value_type == "pv_cpa", "view")


def matches_any(text: Column, keywords: Sequence[str]) -> Column:
    """Case-blind containment of any keyword; blank keywords do not count, none at all match nothing."""
    hit = F.lit(False)
    for word in keywords:
        if word.strip():
            hit = hit | F.lower(text).contains(word.strip().lower())
    return hit
