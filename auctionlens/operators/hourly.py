"""The hourly inventory aggregates, one declarative spec per stored table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import APP_SIZE_KEPT_MEMBER, EXCLUDED_MEMBERS
from auctionlens.functions.predicates import (
    bid_filter, categorised, not_excluded, resold, size_area, supply_class, with_keys,
)
from auctionlens.operators.attribution import (
    AUCTION, attribute, attributed_responses, attributed_rows, count_bids, count_responses, in_hours, with_responses,
)

ALL_PAYMENTS = (0, 3, 4)
CLICK_WINDOW = 1
CONVERSION_WINDOW = 23


@dataclass(frozen=True)
class HourlyJob:
    """Group keys, filters and join kind of one hourly aggregate."""

    keys: tuple[str, ...]
    imp_filter: Callable[[], Column]
    payments: tuple[int, ...] = (0,)
    bid_once: bool = False
    bid_keys: tuple[str, ...] = ()
    chosen_campaigns: bool = False
    response: str = "clicks"
    window_hours: int = CLICK_WINDOW
    measure: str = "clicks"
    zero_fill: bool = False


SITE_KEYS = ("width", "height", "content_category_id", "site_domain", "seller_member_id", "geo_country")
CAMPAIGN_KEYS = (
    "supply_type", "operating_system", "size", "content_category_id", "site_domain", "campaign_id", "geo_country",
)

JOBS: dict[str, HourlyJob] = {
    "agg_auction_features": HourlyJob(
        keys=(
            "operating_system", "supply_type", "content_category_id", "site_domain", "creative_id",
            "geo_country", "width", "height", "campaign_id", "buyer_member_id",
        ),
        imp_filter=lambda: resold() & categorised(),
        bid_keys=("campaign_id",),
        zero_fill=True,
    ),
    "agg_display_rtb": HourlyJob(
        keys=("supply_type", *SITE_KEYS),
        imp_filter=lambda: resold() & not_excluded() & categorised(),
    ),
    "agg_display_os": HourlyJob(
        keys=("supply_type", "operating_system", *SITE_KEYS),
        imp_filter=lambda: supply_class("display") & not_excluded() & categorised(),
        payments=ALL_PAYMENTS,
        bid_once=True,
    ),
    "agg_social": HourlyJob(
        keys=("operating_system", "width", "height", "geo_country"),
        imp_filter=lambda: supply_class("social") & not_excluded() & categorised(),
        payments=ALL_PAYMENTS,
        bid_once=True,
    ),
    "agg_mobile_app": HourlyJob(
        keys=("device_id", "operating_system", "application_id", "geo_country"),
        imp_filter=lambda: supply_class("app") & not_excluded(),
        payments=ALL_PAYMENTS,
        bid_once=True,
    ),
    "agg_mobile_app_size": HourlyJob(
        keys=("device_id", "application_id", "width", "height", "geo_country"),
        imp_filter=lambda: supply_class("app")
        & resold()
        & not_excluded(members=[m for m in EXCLUDED_MEMBERS if m != APP_SIZE_KEPT_MEMBER]),
    ),
    "agg_mobile_web": HourlyJob(
        keys=("device_id", "operating_system", "geo_country", "width", "height", "site_domain", "content_category_id"),
        imp_filter=lambda: supply_class("mobile_web") & not_excluded(),
        payments=ALL_PAYMENTS,
        bid_once=True,
    ),
    "agg_conversions_seller": HourlyJob(
        keys=("supply_type", "operating_system", *SITE_KEYS),
        imp_filter=lambda: resold() & not_excluded() & categorised(),
        response="conversions",
        window_hours=CONVERSION_WINDOW,
        measure="pc_convs",
    ),
    "agg_conversions_campaign": HourlyJob(
        keys=CAMPAIGN_KEYS,
        imp_filter=lambda: resold() & not_excluded() & categorised(),
        payments=ALL_PAYMENTS,
        bid_keys=("campaign_id",),
        chosen_campaigns=True,
        response="conversions",
        window_hours=CONVERSION_WINDOW,
        measure="pc_convs",
    ),
    "agg_campaign_clicks": HourlyJob(
        keys=CAMPAIGN_KEYS,
        imp_filter=lambda: not_excluded() & categorised(),
        payments=ALL_PAYMENTS,
        bid_keys=("campaign_id",),
        chosen_campaigns=True,
    ),
}

#: Copies of a row that are written out together.
COPY_BLOCK = 4096

FOUR_WAY = ("agg_social", "agg_display_os", "agg_mobile_app", "agg_mobile_web")


def _counted_bids(job: HourlyJob, bids: DataFrame, campaigns: DataFrame | None) -> DataFrame:
    """The job's bids per auction, hour and bid key.

    The chosen campaigns are the biggest ones, so raw bids are never shuffled on
    the campaign: they are counted per auction first, and the counted rows meet
    the campaign list.
    """
    if not job.chosen_campaigns:
        return count_bids(bids.where(bid_filter(job.payments)), job.bid_keys, job.bid_once)
    if campaigns is None:
        raise ValueError("this job needs the chosen campaigns")
    counted = count_bids(bids.where(F.col("payment_type").isin(list(job.payments))), job.bid_keys, job.bid_once)
    return counted.join(campaigns.select("campaign_id"), "campaign_id", "left_semi")


def responses_for(job: HourlyJob, responses: DataFrame) -> DataFrame:
    return responses.where(F.col("post_click_conv") == 1) if job.response == "conversions" else responses


def hourly_aggregate(
    name: str,
    imps: DataFrame,
    bids: DataFrame,
    responses: DataFrame,
    campaigns: DataFrame | None = None,
    hours: Sequence[str] | None = None,
    dedup_responses: bool = False,
    colocated: bool = False,
) -> DataFrame:
    """One aggregate for all the given hours in a single job: ``dh`` + keys + two measures.

    ``colocated`` tells that the impressions are stored in buckets of their auction
    (``schemas.create_table``) and need no shuffle.
    """
    job = JOBS[name]
    wanted = in_hours(imps, hours).where(job.imp_filter())
    if "size" in job.keys:
        wanted = wanted.withColumn("size", size_area())
    wanted = wanted.select("auction_id_64", "dh", *[k for k in job.keys if k not in job.bid_keys])
    counted = with_responses(
        _counted_bids(job, in_hours(bids, hours), campaigns),
        count_responses(responses_for(job, responses), job.window_hours, hours),
        job.window_hours,
        dedup_responses,
    )
    matched = attribute(wanted, counted, colocated)
    return matched.groupBy("dh", *job.keys).agg(
        attributed_rows(), attributed_responses(job.measure, job.zero_fill)
    )


def four_way_aggregate(
    imps: DataFrame, bids: DataFrame, clicks: DataFrame, hours: Sequence[str] | None = None, colocated: bool = False
) -> DataFrame:
    """Four stored tables from one scan, one join and one aggregation.

    Each matched impression is handed to the targets whose filter it passes (at
    most two), with the keys of the others NULL, so nothing has to be cached
    between the outputs. Long form: ``target`` + ``dh`` + all keys + measures.
    """
    all_keys = sorted({k for t in FOUR_WAY for k in JOBS[t].keys})
    filters = {t: JOBS[t].imp_filter() for t in FOUR_WAY}
    targets = F.array_compact(F.array(*[F.when(passes, F.lit(t)) for t, passes in filters.items()]))
    wanted = (
        in_hours(imps, hours)
        .where(reduce(lambda a, b: a | b, filters.values()))
        .select("auction_id_64", "dh", *all_keys, targets.alias("targets"))
    )
    counted = with_responses(
        count_bids(in_hours(bids, hours).where(bid_filter(ALL_PAYMENTS)), once=True),
        count_responses(clicks, CLICK_WINDOW, hours),
        CLICK_WINDOW,
    )
    matched = attribute(wanted, counted, colocated).withColumn("target", F.explode_outer("targets"))

    def own(key: str) -> Column:
        users = [t for t in FOUR_WAY if key in JOBS[t].keys]
        return F.when(F.col("target").isin(users), F.col(key)).alias(key)

    return (
        matched.select("target", "dh", "n_bids", "n_responses", *[own(k) for k in all_keys])
        .groupBy("target", "dh", *all_keys)
        .agg(attributed_rows(), attributed_responses("clicks"))
    )


def one_target(four_way: DataFrame, target: str) -> DataFrame:
    """A single stored table out of the long form."""
    return four_way.where(F.col("target") == target).select("dh", *JOBS[target].keys, "imps", "clicks")


def big_cpa_campaigns(categorizer: DataFrame, quick_stats: DataFrame, min_imps: int) -> DataFrame:
    """Large campaigns with exactly one post-click payout and believable clicks."""
    single_payout = (
        categorizer.where(
            F.col("type").isin("rtb_event_payout", "rtb_cpm_payout") & (F.col("value_type") == "pc_cpa")
        )
        .groupBy("campaign_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = 1")
        .select("campaign_id")
    )
    stats = _weekly_campaign_stats(quick_stats, min_imps)
    return stats.join(single_payout, "campaign_id", "left_semi").where(
        F.col("clicks") > 2 * F.col("post_click_convs")
    )


def big_campaigns(quick_stats: DataFrame, min_imps: int) -> DataFrame:
    return _weekly_campaign_stats(quick_stats, min_imps)


def _weekly_campaign_stats(quick_stats: DataFrame, min_imps: int) -> DataFrame:
    weekly = (F.col("time_interval") == "7day") & (F.col("report_type") == "campaign")
    return quick_stats.where(weekly & (F.col("imps") > min_imps)).select(
        F.col("object_id").alias("campaign_id"),
        "imps", "clicks", "post_view_convs", "post_click_convs", "booked_revenue",
    )


def tree_campaigns(bid_models: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Active campaigns with a live bid model."""
    models = bid_models.where("deleted = 0").select(F.col("bid_model_id").alias("model_id"), "campaign_id")
    live = campaigns.where("deleted = 0 AND state = 'active'").select(F.col("id").alias("campaign_id"))
    return models.join(live, "campaign_id").select("model_id", "campaign_id")


def tree_campaign_imps(
    imps: DataFrame,
    bids: DataFrame,
    pixels: DataFrame,
    campaigns: DataFrame,
    end_hour: str,
    hours: Sequence[str] | None = None,
    counted: bool = False,
) -> DataFrame:
    """Every impression bought by the campaigns, with the pixels fired up to ``end_hour``.

    All columns of ``imps`` are kept. Repeated bids and fires of a pixel are one
    counted row; with ``counted`` the result stays that way, with the number of
    equal rows in ``copies``, otherwise they are written out last. Bids and fires
    are counted and joined to each other first, so the wide log is shuffled once.
    """
    chosen = campaigns.select("campaign_id")
    bid_columns = ["campaign_id", *[c for c in ("targeted_segments",) if c in bids.columns]]
    bought = count_bids(in_hours(bids, hours), bid_columns).join(chosen, "campaign_id", "left_semi")
    fired = (
        pixels.where(F.col("dh") <= end_hour)
        .groupBy(F.col("auction_id_64").alias("fired_id"), "pixel_id", "campaign_id", F.col("dh").alias("pixel_dh"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(chosen, "campaign_id", "left_semi")
        .drop("campaign_id")
    )
    in_time = (F.col("auction_id_64") == F.col("fired_id")) & (F.col("pixel_dh") >= F.col("dh"))
    pairs = (
        bought.join(fired, in_time, "left")
        .groupBy(*AUCTION, *bid_columns, "n_bids", "pixel_id")
        .agg((F.col("n_bids") * F.coalesce(F.sum("n"), F.lit(1))).alias("copies"))
        .drop("n_bids")
    )
    spread = F.xxhash64(*AUCTION)  # a shuffle of its own, which can be split where an auction is hot
    matched = (
        in_hours(imps, hours)
        .withColumn("pair_key", spread)
        .join(pairs.withColumn("pair_key", spread), ["pair_key", *AUCTION], "inner")
        .select(*imps.columns, *bid_columns, "pixel_id", "copies")
    )
    return matched if counted else _written_out(matched, "copies")


def _written_out(df: DataFrame, copies: str, block: int = COPY_BLOCK) -> DataFrame:
    """Every row as often as ``copies`` says, by way of blocks, so that no row holds all its copies in one array."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / block))
    of_block = F.least(F.lit(block).cast("bigint"), F.col(copies) - F.col("__block") * block)
    return (
        df.withColumn("__block", F.explode(blocks))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), of_block)))
        .drop(copies, "__block", "__copy")
    )


def day_rollup(hourly: DataFrame, keys: Sequence[str], measure: str = "clicks") -> DataFrame:
    """Hours folded into a day; groups without responses count 0, NULL keys are dropped."""
    return (
        with_keys(hourly, keys)
        .groupBy(F.col("dh").substr(1, 10).alias("dd"), *keys)
        .agg(F.sum("imps").alias("imps"), F.coalesce(F.sum(measure), F.lit(0)).alias(measure))
    )


EXPORTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "hourly_export_web": (
        "agg_display_os",
        ("site_domain", "content_category_id", "supply_type", "width", "height", "geo_country", "operating_system"),
    ),
    "hourly_export_mobile_web": (
        "agg_mobile_web",
        ("site_domain", "content_category_id", "device_id", "width", "height", "geo_country", "operating_system"),
    ),
    "hourly_export_app": ("agg_mobile_app", ("device_id", "operating_system", "geo_country", "application_id")),
    "hourly_export_social": ("agg_social", ("operating_system", "width", "height", "geo_country")),
}


def hourly_export(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.groupBy("dh", *keys).agg(F.sum("imps").alias("imps"), F.sum("clicks").alias("clicks"))
