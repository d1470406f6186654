"""Explicit schemas of inputs and stored outputs."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(),
    "double": T.DoubleType(), "float": T.FloatType(), "strings": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def _hourly(measure: str = "clicks", **keys: str) -> T.StructType:
    return _schema(**keys, imps="bigint", **{measure: "bigint"}, dd="string", dh="string")


_SITE = dict(
    width="int", height="int", content_category_id="int", site_domain="string", geo_country="string",
    seller_member_id="int",
)
_CAMPAIGN = dict(
    supply_type="int", operating_system="string", size="int", content_category_id="int", site_domain="string",
    geo_country="string", campaign_id="int",
)

# Stored hourly aggregates; ``dd`` and ``dh`` are the partition columns.
HOURLY_TABLES: dict[str, T.StructType] = {
    "agg_auction_features": _hourly(
        operating_system="string", supply_type="int", content_category_id="int", site_domain="string",
        creative_id="bigint", geo_country="string", width="int", height="int", campaign_id="int",
        buyer_member_id="int",
    ),
    "agg_display_rtb": _hourly(supply_type="int", **_SITE),
    "agg_display_os": _hourly(supply_type="int", operating_system="string", **_SITE),
    "agg_social": _hourly(operating_system="string", width="int", height="int", geo_country="string"),
    "agg_mobile_app": _hourly(device_id="int", operating_system="int", geo_country="string", application_id="string"),
    "agg_mobile_app_size": _hourly(
        device_id="int", width="int", height="int", geo_country="string", application_id="string"
    ),
    "agg_mobile_web": _hourly(
        device_id="int", operating_system="int", geo_country="string", width="int", height="int",
        site_domain="string", content_category_id="int",
    ),
    "agg_conversions_seller": _hourly("pc_convs", supply_type="int", operating_system="string", **_SITE),
    "agg_conversions_campaign": _hourly("pc_convs", **_CAMPAIGN),
    "agg_campaign_clicks": _hourly(**_CAMPAIGN),
}

# The hourly logs.
IMPS = _schema(
    auction_id_64="bigint", dh="string", operating_system="string", supply_type="int", device_type="int",
    device_id="int", width="int", height="int", content_category_id="int", site_domain="string",
    application_id="string", geo_country="string", seller_member_id="int", buyer_member_id="int", creative_id="bigint",
)
BIDS = _schema(auction_id_64="bigint", dh="string", payment_type="int", campaign_id="int")
CLICKS = _schema(auction_id_64="bigint", dh="string")
CONVERSIONS = _schema(auction_id_64="bigint", dh="string", post_click_conv="int")

CAMPAIGN_PIXEL_META = _schema(
    campaign_group_id="int", campaign_id="int", pixel_id="int", event_type="string", revenue="float",
    advertiser_goal="float", rtb_cpm_payout="float", goal_target="float",
    dy="string", dm="string", dd="string", dh="string",
)

SITE_DAILY_STATS = _schema(
    ymd="string", seller_member_id="int", site_id="int", in_programme="int",
    imps="bigint", perf_imps="bigint", perf_managed_imps="bigint", perf_xnet_imps="bigint",
    learn_imps="bigint", learn_managed_imps="bigint", learn_xnet_imps="bigint",
    revenue="double", perf_rev="double", perf_managed_rev="double", perf_xnet_rev="double",
    learn_rev="double", learn_managed_rev="double", learn_xnet_rev="double",
)

LEXICON = _schema(term="string", score="int")

PAGE_FEATURES = _schema(
    page_id="bigint", domain="string", title="string", meta_description="string", meta_keywords="strings",
    ref_titles="strings", img_alt_titles="strings", content="strings",
)

TWEET = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("user", _schema(screen_name="string", location="string")),
        T.StructField("place", _schema(full_name="string", country_code="string")),
        T.StructField("entities", T.StructType([T.StructField("hashtags", T.ArrayType(_schema(text="string")))])),
    ]
)


TREE_CAMPAIGN_IMPS = T.StructType([
    *[f for f in IMPS if f.name != "dh"],
    *_schema(campaign_id="int", pixel_id="bigint", dy="string", dm="string", dd="string", dh="string"),
])


def create_table(
    spark,
    name: str,
    schema: T.StructType,
    partitions: tuple[str, ...] = ("dd", "dh"),
    bucket_by: str | None = None,
    buckets: int = 0,
) -> None:
    """Define a stored table as a partitioned parquet table of the session catalog.

    With ``bucket_by`` the rows of a partition lie in sorted buckets of that column, so joins on it need no shuffle.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    layout = f" CLUSTERED BY ({bucket_by}) SORTED BY ({bucket_by}) INTO {buckets} BUCKETS" if bucket_by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({', '.join(partitions)}){layout}"
    )
