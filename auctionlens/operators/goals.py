"""Line-item goals and the node metrics they are checked against."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import GOAL_IMP_TYPES
from auctionlens.functions.predicates import in_size_bucket, size_area, size_bucket, with_keys
from auctionlens.functions.timeparts import truncate_to_hour
from auctionlens.operators.lookups import with_country_group

NODE = ["campaign_group_id", "tag_id", "country_group_id", "creative_size_bucket_id", "ymdh"]


def line_item_goals(campaign_group: DataFrame, valuation: DataFrame, goal: DataFrame) -> DataFrame:
    """Goals of live line items in the three goal classes, as ``goal_type`` tells.

    A line item with several valuations or goal rows keeps them all. Columns
    that mean nothing to a class are NULL.
    """
    values = valuation.select(
        F.col("campaign_group_id").alias("cg_id"), "goal_threshold", F.col("deleted").alias("valuation_deleted")
    )
    goals = goal.select(
        F.col("campaign_group_id").alias("cg_id"),
        "pixel_id",
        F.col("post_view_goal_threshold").alias("pvg_threshold"),
        F.col("post_click_goal_threshold").alias("pcg_threshold"),
        F.col("deleted").alias("goal_deleted"),
    )
    items = (
        campaign_group.where("deleted = 0")
        .select(F.col("id").alias("cg_id"), "goal_type", "revenue_type")
        .join(values, "cg_id", "left")
        .join(goals, "cg_id", "left")
    )
    ctr, cpc, cpa = (F.col("goal_type") == t for t in ("ctr", "cpc", "cpa"))
    has_value = F.col("goal_threshold").isNotNull()
    has_goal = F.col("pvg_threshold").isNotNull() | F.col("pcg_threshold").isNotNull()
    live = {c: F.coalesce(c, F.lit(0)) != 1 for c in ("valuation_deleted", "goal_deleted")}
    usable = (
        (ctr & has_value & live["valuation_deleted"])
        | (cpc & has_value)
        | (cpa & has_goal & live["goal_deleted"])
    )
    return items.where(usable).select(
        "cg_id",
        "goal_type",
        "revenue_type",
        F.when(~cpa, F.col("goal_threshold")).alias("goal_threshold"),
        *[F.when(~ctr, F.col(c)).alias(c) for c in ("pixel_id", "pvg_threshold", "pcg_threshold")],
    )


def goals_of(goals: DataFrame, goal_type: str) -> DataFrame:
    return goals.where(F.col("goal_type") == goal_type)


def conform_line_items(goals: DataFrame) -> DataFrame:
    """All goals in one shape: line item, goal type, value and pixel."""

    kind = F.col("goal_type")

    def shaped(goal_type: Column, value: str, pixel: Column) -> Column:
        return F.struct(
            goal_type.alias("goal_type"), F.col(value).cast("double").alias("goal_value"), pixel.alias("pixel_id")
        )

    no_pixel, pixel = F.lit(0), F.col("pixel_id").cast("int")
    # One pass: a goal of each payout kind becomes one row, or two.
    rows = F.when(kind.isin("ctr", "cpc"), F.array(shaped(kind, "goal_threshold", no_pixel))).when(
        kind == "cpa",
        F.array(
            shaped(F.lit("cpa_post_click"), "pcg_threshold", pixel),
            shaped(F.lit("cpa_post_view"), "pvg_threshold", pixel),
        ),
    )
    shapes = goals.select(F.col("cg_id").alias("line_item"), F.explode(rows).alias("g"))
    return shapes.select("line_item", "g.*").where("goal_value IS NOT NULL")


def _sum(column: str, name: str | None = None) -> Column:
    return F.sum(column).alias(name or column)


def _booked() -> list[Column]:
    return [_sum("booked_revenue_adv_curr", "booked_rev"), _sum("booked_revenue_dollars", "booked_rev_dol")]


def _volumes() -> list[Column]:
    return [_sum("imps"), _sum("clicks"), _sum("post_click_convs", "pcc"), _sum("post_view_convs", "pvc")]


def _counted(fact: DataFrame, start: str, end: str) -> DataFrame:
    return fact.where(F.col("ymdh").between(start, end) & F.col("imp_type").isin(list(GOAL_IMP_TYPES)))


def _of_line_items(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Applied to aggregated rows; a short id list still filters the scan (see ``of_sites``)."""
    return rows.join(ids.select(F.col(key).alias("campaign_group_id")), "campaign_group_id", "left_semi")


def node_metrics(
    fact: DataFrame,
    country: DataFrame,
    campaign_group_id: int,
    country_group_id: int,
    tag_id: int,
    size_bucket_id: int,
    start: str,
    end: str,
    pixel_id: int = -1,
) -> DataFrame:
    """Hourly metrics of one node."""
    codes = country.where(F.col("country_group_id") == country_group_id).select(F.col("code").alias("geo_country"))
    return (
        _counted(fact, start, end)
        .where(
            (F.col("campaign_group_id") == campaign_group_id)
            & (F.col("tag_id") == tag_id)
            & in_size_bucket(size_bucket_id)
            & F.col("pixel_id").isin(0, pixel_id)
        )
        .join(codes.distinct(), "geo_country", "left_semi")
        .groupBy("ymdh")
        .agg(*_volumes(), *_booked())
    )


def ctr_node_rows(fact: DataFrame, goals: DataFrame, start: str, end: str) -> DataFrame:
    """Hourly click metrics per line item, tag, country and size (rows without a pixel)."""
    rows = _counted(fact, start, end).where("pixel_id = 0").withColumn("size", size_area())
    hourly = rows.groupBy("ymdh", "campaign_group_id", "tag_id", "geo_country", "size").agg(
        _sum("imps"), _sum("clicks"), *_booked()
    )
    return _of_line_items(hourly, goals, "cg_id")


def cpa_node_rows(fact: DataFrame, goals: DataFrame, start: str, end: str) -> DataFrame:
    """Hourly conversion metrics per line item, pixel, tag, country and size."""
    rows = _counted(fact, start, end).withColumn("size", size_area())
    hourly = rows.groupBy("ymdh", "campaign_group_id", "pixel_id", "tag_id", "geo_country", "size").agg(
        *_booked(), _sum("post_view_convs"), _sum("post_click_convs")
    )
    return _of_line_items(hourly, goals, "cg_id")


def _to_nodes(rows: DataFrame, country: DataFrame, upper: bool) -> DataFrame:
    return with_country_group(rows, country, upper).withColumn("creative_size_bucket_id", size_bucket(F.col("size")))


def click_node_aggregates(
    fact: DataFrame, country: DataFrame, goals: DataFrame, goal_type: str, start: str, end: str
) -> DataFrame:
    """Node x hour metrics of the ctr or cpc line items."""
    items = goals_of(goals, goal_type)
    rows = _to_nodes(ctr_node_rows(fact, items, start, end), country, upper=True)
    return (
        with_keys(rows, NODE)
        .groupBy(*NODE)
        .agg(*[F.sum(c).alias(c) for c in ("booked_rev", "booked_rev_dol", "imps", "clicks")])
    )


def goal_pixels(goals: DataFrame) -> DataFrame:
    """One pixel per cpa line item; the largest id when there are several."""
    return (
        goals_of(goals, "cpa")
        .groupBy(F.col("cg_id").alias("campaign_group_id"))
        .agg(F.max("pixel_id").alias("goal_pixel"))
    )


def cpa_node_aggregates(fact: DataFrame, country: DataFrame, goals: DataFrame, start: str, end: str) -> DataFrame:
    """Node x hour metrics of the cpa line items.

    Rows without a pixel take their line item's goal pixel and stay rows of
    their own; rows of a pixel that is nobody's goal are dropped.
    """
    items = goals_of(goals, "cpa")
    pixels = goal_pixels(goals)
    rows = _to_nodes(cpa_node_rows(fact, items, start, end), country, upper=False)
    merged = (
        with_keys(rows, ["pixel_id", *NODE])
        .groupBy("pixel_id", *NODE)
        .agg(*[F.sum(c).alias(c) for c in ("booked_rev", "booked_rev_dol", "post_view_convs", "post_click_convs")])
    )
    own = F.when((F.col("pixel_id") == 0) & F.col("goal_pixel").isNotNull(), F.col("goal_pixel"))
    return (
        merged.join(pixels, "campaign_group_id", "left")
        .withColumn("pixel_id", F.coalesce(own, F.col("pixel_id")))
        .drop("goal_pixel")
        .join(pixels.select(F.col("goal_pixel").alias("pixel_id")).distinct(), "pixel_id", "left_semi")
    )


TOTALS = ("imps", "clicks", "pcc", "pvc", "booked_rev", "booked_rev_dol")


def _goal_totals(fact: DataFrame, line_items: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per key over rows whose pixel is 0 or a goal pixel of any of the line items.

    Summed per pixel first, so that the pixel check runs on reduced rows.
    """
    zero = line_items.sparkSession.range(1).select(F.lit(0).alias("pixel_id"))
    pixels = line_items.select(F.col("pixel_id").cast("int")).union(zero)
    per_pixel = fact.groupBy(*keys, "pixel_id").agg(*_volumes(), *_booked())
    return (
        per_pixel.join(pixels, "pixel_id", "left_semi").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in TOTALS])
    )


def camp_perf(fact: DataFrame, line_items: DataFrame, start: str, end: str) -> DataFrame:
    """Totals per line item between two hours, both included."""
    return _of_line_items(_goal_totals(_counted(fact, start, end), line_items, ["campaign_group_id"]), line_items, "line_item")


def latest_exclusions(exclusion: DataFrame, start: str, end: str) -> DataFrame:
    """The last state change of each node inside the window, undecided states left out."""
    node = ["campaign_group_id", "country_group_id", "tag_id", "creative_size_bucket_id"]
    newest = F.max_by(F.struct("exclusion_state_id", "last_modified"), F.struct("last_modified", "id"))
    return (
        exclusion.where(
            (F.col("last_modified") >= start)
            & (F.col("last_modified") < end)
            & (F.col("exclusion_state_id") != 1)
            & (F.col("active") == 1)
        )
        .groupBy(*node)
        .agg(newest.alias("newest"))
        .select(*node, "newest.*")
    )


def exclusion_counts(exclusion: DataFrame, start: str, end: str) -> DataFrame:
    """Nodes passed and excluded per hour and line item."""
    state = F.col("exclusion_state_id")
    return (
        latest_exclusions(exclusion, start, end)
        .groupBy(truncate_to_hour(F.col("last_modified")).alias("ymdh"), "campaign_group_id")
        .agg(
            F.sum((state == 2).cast("bigint")).alias("number_of_passed_buckets"),
            F.sum((state == 3).cast("bigint")).alias("number_of_excluded_buckets"),
        )
    )


def camp_perf_hourly(
    fact: DataFrame, exclusion: DataFrame, line_items: DataFrame, start: str, end: str
) -> DataFrame:
    """Hourly performance, state changes and goals per line item; ``end`` itself is left out.

    The join that brings the goals also tells which rows are of a line item at all.
    """
    window = fact.where((F.col("ymdh") >= start) & (F.col("ymdh") < end) & F.col("imp_type").isin(list(GOAL_IMP_TYPES)))
    perf = _goal_totals(window, line_items, ["ymdh", "campaign_group_id"]).withColumn(
        "ymdh", F.concat("ymdh", F.lit(":00:00"))
    )
    changes = exclusion_counts(exclusion, start, end)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("number_of_passed_buckets", "number_of_excluded_buckets")]
    goals = line_items.withColumnRenamed("line_item", "campaign_group_id")
    return (
        perf.fillna(0)
        .join(goals, "campaign_group_id")
        .join(changes, ["ymdh", "campaign_group_id"], "left")
        .select(
            "campaign_group_id", "ymdh", *TOTALS, *counts, F.lit("None").alias("group_type"),
            *[c for c in goals.columns if c != "campaign_group_id"],
        )
    )


