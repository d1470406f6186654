"""Every job and operator bound to the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from auctionlens.functions.predicates import in_size_bucket, size_area, size_bucket
from auctionlens.functions.timeparts import hours_of_day
from auctionlens.operators import (
    backfill, buckets, campaign_meta, clog, confusion, goals, hourly, impurity, lookups, pages, reporting, tweets,
)
from auctionlens.plans import stored
from auctionlens.sources.catalog import Catalog
from auctionlens.sources.fixtures import fixture_catalog
from auctionlens.sources.readers import parse_tweets

# The given tables span 1995 to 2001 (fact) and one day of auctions; these
# parameters take all of it in.
AS_OF = "2001-12-01"
LOOKBACK_DAYS = 3000
START, END = "1995-01-01 00", "2002-01-01 00"
AUCTION_DAY, AUCTION_AS_OF = "2024-01-01", "2024-01-02 00"
TREE_END_HOUR = "2024-01-02 01"
#: Later than any auction and its responses by more than the allowed delay.
STREAM_END = "2024-01-06 00"

# Thresholds on the scale of the given tables.
SITE_MIN_IMPS = 20
CPA_CAMPAIGN_IMPS = 3000
CAMPAIGN_IMPS = 7000
FEATURES = ("site_id", "tag_id", "seller_member_id")
MIN_IMPS = 2300
DELETE_BELOW = 2000
GROW_ABOVE = 3500
MATRIX_FEATURES = ("site_id", "geo_country", "tag_id", "campaign_group_id")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Money is summed exactly and handed out as double."""
    money = [f.name for f in df.schema if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in money}) if money else df


def _query(name: str) -> Callable[[Callable[[Catalog], DataFrame]], Callable[[Catalog], DataFrame]]:
    def register(build: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        _QUERIES[name] = lambda spark, sf_dir: decimals_to_double(build(fixture_catalog(spark, sf_dir)))
        return build

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Hourly aggregates


def _big_campaigns(t: Catalog) -> DataFrame:
    return hourly.big_campaigns(t["quick_stats"], CAMPAIGN_IMPS)


def _chosen_campaigns(name: str, t: Catalog) -> DataFrame:
    """Conversions are kept for the campaigns with a single post-click payout, clicks for all big ones."""
    if name == "agg_conversions_campaign":
        return hourly.big_cpa_campaigns(t["categorizer"], t["quick_stats"], CPA_CAMPAIGN_IMPS)
    return _big_campaigns(t)


def _hourly(name: str, t: Catalog) -> DataFrame:
    job = hourly.JOBS[name]
    campaigns = _chosen_campaigns(name, t) if job.chosen_campaigns else None
    return hourly.hourly_aggregate(name, t["imps"], t["bids"], t[job.response], campaigns)


for _name in hourly.JOBS:
    _query(_name)(lambda t, name=_name: _hourly(name, t))

for _name, (_stored, _keys) in hourly.EXPORTS.items():
    _query(_name)(lambda t, stored=_stored, keys=_keys: hourly.hourly_export(_hourly(stored, t), keys))


@_query("agg_conversions_day")
def _(t):
    """One day, by the literal hour list of a production run."""
    return hourly.hourly_aggregate(
        "agg_conversions_seller", t["imps"], t["bids"], t["conversions"], hours=hours_of_day(AUCTION_DAY)
    )


@_query("agg_four_way")
def _(t):
    return hourly.four_way_aggregate(t["imps"], t["bids"], t["clicks"])


@_query("day_rollup")
def _(t):
    keys = hourly.EXPORTS["hourly_export_web"][1]
    return hourly.day_rollup(_hourly("agg_display_os", t), keys)


@_query("big_cpa_campaigns")
def _(t):
    return hourly.big_cpa_campaigns(t["categorizer"], t["quick_stats"], CPA_CAMPAIGN_IMPS)


@_query("big_campaigns")
def _(t):
    return _big_campaigns(t)


@_query("tree_campaigns")
def _(t):
    return hourly.tree_campaigns(t["bid_model"], t["campaign"])


@_query("tree_campaign_imps")
def _(t):
    chosen = hourly.tree_campaigns(t["bid_model"], t["campaign"])
    return hourly.tree_campaign_imps(t["imps"], t["bids"], t["pixel_fires"], chosen, TREE_END_HOUR)


# Backfill


@_query("ready_hours")
def _(t):
    return backfill.ready_hours(t["imps"], t["bids"], t["clicks"], t["aggregated_hours"], AUCTION_AS_OF)


@_query("retained_hours")
def _(t):
    return backfill.retained_hours(t["clicks"], "2024-01-09 12", 8)


@_query("hours_to_load")
def _(t):
    return backfill.hours_to_load(t["conversions"], t["aggregated_hours"])


@_query("incremental_rows")
def _(t):
    return backfill.incremental_rows(t["conversions"], t["aggregated_hours"])


# Reporting


@_query("site_daily_stats")
def _(t):
    return reporting.site_daily_stats(t["perf_fact"], t["marketplace"], SITE_MIN_IMPS)


def _perf(t: Catalog, by_hour: bool = False) -> DataFrame:
    return reporting.perf_data(t["perf_fact"], t["programme"], AS_OF, LOOKBACK_DAYS, by_hour)


@_query("perf_data_daily")
def _(t):
    return _perf(t)


@_query("perf_data_hourly")
def _(t):
    return _perf(t, True)


@_query("perf_ratios")
def _(t):
    return reporting.perf_ratios(_perf(t), ["ymd", "seller_member_id"])


@_query("learn_share")
def _(t):
    return reporting.learn_share(t["perf_fact"], t["programme"], AS_OF, LOOKBACK_DAYS)


@_query("learn_share_hourly")
def _(t):
    return reporting.learn_share(
        t["perf_fact"], t["programme"], AS_OF, LOOKBACK_DAYS, 300, 250, ["NATION_1", "NATION_2", "NATION_3"], True
    )


@_query("code_labels")
def _(t):
    codes = ["imp_type", "revenue_type", "predict_type_rev"]
    counts = t["perf_fact"].groupBy(*codes).agg(F.sum("imps").alias("imps"))
    return lookups.with_predict_type_name(lookups.with_revenue_type_name(lookups.with_imp_type_name(counts)))


@_query("offer_states")
def _(t):
    return lookups.with_opt_state_name(t["offers"].groupBy("opt_state").agg(F.count(F.lit(1)).alias("offers")))


@_query("size_buckets")
def _(t):
    return (
        t["imps"]
        .groupBy("width", "height", size_bucket(size_area()).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("imps"))
    )


@_query("size_predicates")
def _(t):
    inside = {f"bucket_{b}": F.sum(in_size_bucket(b).cast("bigint")) for b in range(7)}
    return t["imps"].agg(*[v.alias(k) for k, v in inside.items()])


# Sites and lookups


@_query("programme_sites")
def _(t):
    return lookups.programme_sites(t["site"], t["marketplace"])


@_query("programme_sites_member")
def _(t):
    return lookups.programme_sites_of_member(t["site"], t["marketplace"], 15, "2024-01-01")


@_query("map_sell_side_keys")
def _(t):
    data = t["perf_fact"].groupBy("site_id", "geo_country", "width", "height").agg(F.sum("imps").alias("imps"))
    return lookups.map_sell_side_keys(data, t["site"], t["country"], t["creative_sizes"])


@_query("sites_of_publishers")
def _(t):
    wanted = t["programme"].join(t["site"], F.col("site_id") == F.col("id")).select("publisher_id")
    return lookups.sites_of_publishers(t["site"], wanted)


@_query("site_bucket_map")
def _(t):
    return lookups.site_bucket_map(t["site"])


@_query("sites_of_buckets")
def _(t):
    wanted = t["offers"].where("opt_state = 0").select("bucket_id").distinct()
    return lookups.sites_of_buckets(t["site"], t["marketplace"], wanted)


@_query("site_closure")
def _(t):
    return lookups.site_closure(t["site"], t["marketplace"], t["programme"])


@_query("size_bucket_map")
def _(t):
    return lookups.size_bucket_map(t["creative_sizes"])


@_query("clogged_nodes")
def _(t):
    return clog.clogged_nodes(
        t["perf_fact"], t["programme"], t["offers"], t["site"], t["country"], t["creative_sizes"],
        t["campaign_group"], AS_OF, LOOKBACK_DAYS,
    )


# Campaign metadata and goals


@_query("campaigns_by_target")
def _(t):
    wanted = t["campaign"].select(F.col("id").alias("campaign_id"))
    targets = [t["profile_target_age"], t["profile_target_segment"]]
    return campaign_meta.campaigns_by_target(t["campaign"], t["campaign_group"], wanted, targets)


@_query("campaign_pixel_meta")
def _(t):
    return campaign_meta.campaign_pixel_meta(
        t["pixel"], t["group_pixel"], t["campaign_group"], t["campaign"], t["currency"], t["categorizer"], t["goal"]
    )


def _goals(t: Catalog) -> DataFrame:
    return goals.line_item_goals(t["campaign_group"], t["valuation"], t["goal"])


def _line_items(t: Catalog) -> DataFrame:
    return goals.conform_line_items(_goals(t))


@_query("line_item_goals")
def _(t):
    return _goals(t)


@_query("conform_line_items")
def _(t):
    return _line_items(t)


@_query("node_metrics")
def _(t):
    return goals.node_metrics(t["perf_fact"], t["country"], 8, 1, 2, 2, START, END, 108)


@_query("ctr_node_rows")
def _(t):
    return goals.ctr_node_rows(t["perf_fact"], goals.goals_of(_goals(t), "ctr"), START, END)


@_query("cpa_node_rows")
def _(t):
    return goals.cpa_node_rows(t["perf_fact"], goals.goals_of(_goals(t), "cpa"), START, END)


@_query("node_aggregates_ctr")
def _(t):
    return goals.click_node_aggregates(t["perf_fact"], t["country"], _goals(t), "ctr", START, END)


@_query("node_aggregates_cpc")
def _(t):
    return goals.click_node_aggregates(t["perf_fact"], t["country"], _goals(t), "cpc", START, END)


@_query("node_aggregates_cpa")
def _(t):
    return goals.cpa_node_aggregates(t["perf_fact"], t["country"], _goals(t), START, END)


@_query("camp_perf")
def _(t):
    return goals.camp_perf(t["perf_fact"], _line_items(t), START, END)


@_query("camp_perf_hourly")
def _(t):
    return goals.camp_perf_hourly(t["perf_fact"], t["inventory_exclusion"], _line_items(t), START, END)


@_query("exclusion_counts")
def _(t):
    return goals.exclusion_counts(t["inventory_exclusion"], START, END)


# Buckets


@_query("bucketize")
def _(t):
    return buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)


@_query("bucket_perf")
def _(t):
    built = buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)
    return buckets.bucket_perf(reporting.reported(t["perf_fact"]), built, FEATURES)


@_query("bucket_perf_campaign")
def _(t):
    return buckets.bucket_perf_campaign(
        reporting.reported(t["perf_fact"]), buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS), FEATURES
    )


@_query("campaign_gain")
def _(t):
    built = buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)
    per_campaign = buckets.bucket_perf_campaign(t["perf_fact"], built, FEATURES)
    return _rounded(buckets.campaign_gain(per_campaign), "total_var", "info_gain")


@_query("bucket_update")
def _(t):
    base = buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)
    return buckets.bucket_update(
        reporting.reported(t["perf_fact"]), base, FEATURES, DELETE_BELOW, GROW_ABOVE
    )


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@_query("bucket_variance")
def _(t):
    built = buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)
    return _rounded(buckets.bucket_variance(built), "variance", "variance_2")


@_query("bucket_entropy")
def _(t):
    return _rounded(buckets.bucket_entropy(buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS)), "entropy")


@_query("level_scores")
def _(t):
    scores = buckets.level_scores(buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS))
    return _rounded(scores, "entropy", "variance")


@_query("bucket_summary")
def _(t):
    summary = buckets.bucket_summary(buckets.bucketize(t["perf_fact"], FEATURES, MIN_IMPS))
    return _rounded(summary, "total_var", "info_gain")


@_query("contingency")
def _(t):
    return buckets.contingency(t["perf_fact"], "geo_country", F.col("clicks") > 0)


@_query("key_report")
def _(t):
    return _rounded(
        buckets.key_report(t["perf_fact"], ["site_id", "geo_country"]), "variance", "variance_2", "entropy"
    )


@_query("key_report_histogram")
def _(t):
    return _rounded(buckets.key_report_histogram(t["perf_fact"], ["site_id", "geo_country"]), "bin_start", "percent")


@_query("gini")
def _(t):
    return _rounded(impurity.gini(t["perf_fact"], "campaign_id"), "gini")


@_query("gini_weighted")
def _(t):
    return _rounded(impurity.gini_weighted(t["perf_fact"], ["site_id", "tag_id"]), "gini")


@_query("impurity_matrix")
def _(t):
    return impurity.impurity_matrix(t["perf_fact"], MATRIX_FEATURES)


# Goal checks


@_query("confusion_cpa_v1")
def _(t):
    return confusion.confusion_cpa(t["nodes"], goals.goals_of(_goals(t), "cpa"), summed=True)


@_query("confusion_cpa_v2")
def _(t):
    return confusion.confusion_cpa(t["nodes"], goals.goals_of(_goals(t), "cpa"), summed=False)


@_query("confusion_ctr")
def _(t):
    return confusion.confusion_ctr(t["nodes"], goals.goals_of(_goals(t), "ctr"))


@_query("confusion_def_cpa")
def _(t):
    return confusion.confusion_def_cpa(t["nodes"], goals.goals_of(_goals(t), "cpa"))


@_query("confusion_def_ctr")
def _(t):
    return confusion.confusion_def_ctr(t["nodes"], goals.goals_of(_goals(t), "ctr"))


@_query("confusion_perf_cpa")
def _(t):
    return confusion.confusion_perf_cpa(t["nodes"], goals.goals_of(_goals(t), "cpa"))


@_query("confusion_perf_ctr")
def _(t):
    return confusion.confusion_perf_ctr(t["nodes"], goals.goals_of(_goals(t), "ctr"))


# Text


@_query("page_features")
def _(t):
    """The lists one entry a line; no entry holds a line feed."""
    record = pages.page_features(t["raw_pages"])
    lists = [c for c, kind in record.dtypes if kind.startswith("array")]
    return record.withColumns({c: F.array_join(c, "\n") for c in lists})


@_query("page_anchor_counts")
def _(t):
    return pages.page_anchor_counts(pages.page_features(t["raw_pages"]))


def _tweet_lines(t: Catalog) -> DataFrame:
    """The documents as a tweet file: one JSON object per line."""
    fields = F.struct(
        F.col("tweet_id").alias("id"),
        F.col("tweet_id").cast("string").alias("created_at"),
        "text",
        "lang",
        F.struct("screen_name").alias("user"),
        F.struct(
            F.array(F.struct(F.col("screen_name").alias("text")), F.struct(F.col("lang").alias("text"))).alias("hashtags")
        ).alias("entities"),
    )
    return t["tweets"].select(F.to_json(fields).alias("value"))


@_query("tweet_select")
def _(t):
    return tweets.tweet_select(parse_tweets(_tweet_lines(t)))


@_query("tweet_track")
def _(t):
    return tweets.tweet_track(t["tweets"], "the,aux ,DER").select("tweet_id", "lang")


@_query("tweet_track_many")
def _(t):
    """Tweets that hold the beginning of a benchmark passage, or three letters of one."""
    return tweets.tweet_track_many(t["tweets"], t["tracked"]).select("tweet_id", "lang")


@_query("line_count")
def _(t):
    return tweets.line_count({"tweets": t["tweets"], "pages": t["raw_pages"]})


@_query("tweet_sentiment")
def _(t):
    return tweets.tweet_sentiment(t["tweets"], t["lexicon"])


@_query("tweet_sentiment_phrases")
def _(t):
    return tweets.tweet_sentiment(t["tweets"], t["phrase_lexicon"], max_words=2)


@_query("term_sentiment")
def _(t):
    return tweets.term_sentiment(t["tweets"], t["lexicon"])


@_query("term_frequency")
def _(t):
    return tweets.term_frequency(t["tweets"])


@_query("state_sentiment")
def _(t):
    return tweets.state_sentiment(t["tweets"], t["lexicon"])


@_query("happiest_state")
def _(t):
    return tweets.happiest_state(t["tweets"], t["lexicon"]).select("state", "mean_sentiment")


@_query("top_hashtags")
def _(t):
    return tweets.top_hashtags(t["tweet_hashtags"])


@_query("top_hashtag_entities")
def _(t):
    return tweets.top_hashtags(tweets.hashtag_entities(parse_tweets(_tweet_lines(t))))


# Through storage and streams: the same rows as the jobs above


@_query("stored_display_os")
def _(t):
    return stored.stored_hours(t, "agg_display_os", _hourly("agg_display_os", t))


@_query("stored_auction_features")
def _(t):
    return stored.stored_hours(t, "agg_auction_features", _hourly("agg_auction_features", t), deep=True)


@_query("stored_four_way")
def _(t):
    return stored.stored_four_way(t, hourly.four_way_aggregate(t["imps"], t["bids"], t["clicks"]))


@_query("stored_site_days")
def _(t):
    daily = reporting.site_daily_stats(t["perf_fact"], t["marketplace"], SITE_MIN_IMPS)
    return stored.stored_days(t, decimals_to_double(daily))


@_query("exported_day")
def _(t):
    return stored.exported_day(t, _hourly("agg_display_os", t), "hourly_export_web", AUCTION_DAY)


@_query("listed_ready_hours")
def _(t):
    return stored.ready_hours(t, AUCTION_AS_OF)


@_query("journaled_load")
def _(t):
    return stored.journaled_load(t, "conversions", f"{AUCTION_DAY} 12")


@_query("stream_display_os")
def _(t):
    return stored.streamed(t, "agg_display_os", STREAM_END)


@_query("stream_conversions_seller")
def _(t):
    return stored.streamed(t, "agg_conversions_seller", STREAM_END)
