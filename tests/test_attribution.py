"""Hand-made logs against a row-by-row join in plain Python."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from auctionlens.functions.timeparts import add_hours
from auctionlens.operators import hourly

IMP = (
    "auction_id_64 bigint, dh string, operating_system string, supply_type int, device_type int, device_id int, "
    "width int, height int, content_category_id int, site_domain string, application_id string, geo_country string, "
    "seller_member_id int, buyer_member_id int, creative_id bigint"
)
BID = "auction_id_64 bigint, dh string, payment_type int, campaign_id int"
H = [f"2024-03-10 {h:02d}" for h in range(24)]


def imp(auction, dh=H[1], supply=0, seller=7, width=300, os="1", **more):
    record = dict(
        auction_id_64=auction, dh=dh, operating_system=os, supply_type=supply, device_type=0, device_id=1, width=width,
        height=250, content_category_id=1, site_domain="s", application_id="a", geo_country="US",
        seller_member_id=seller, buyer_member_id=9, creative_id=5,
    )
    record.update(more)
    return tuple(record.values())


def run(spark, name, imps, bids, responses, **kw):
    schema = "auction_id_64 bigint, dh string"
    if hourly.JOBS[name].response == "conversions":
        schema += ", post_click_conv int"
    return hourly.hourly_aggregate(
        name, spark.createDataFrame(imps, IMP), spark.createDataFrame(bids, BID),
        spark.createDataFrame(responses, schema), **kw,
    )


def measures(df):
    return [(r["imps"], r[df.columns[-1]]) for r in df.collect()]


def test_inner_join_multiplies_and_semi_join_does_not(spark):
    imps, bids = [imp(1)], [(1, H[1], 0, 3), (1, H[1], 0, 4), (1, H[1], 3, 4)]
    clicks = [(1, H[1]), (1, H[2])]
    assert measures(run(spark, "agg_display_rtb", imps, bids, clicks)) == [(4, 4)]
    assert measures(run(spark, "agg_display_os", imps, bids, clicks)) == [(2, 2)]
    assert measures(run(spark, "agg_display_os", imps, bids, clicks, dedup_responses=True)) == [(1, 1)]


def test_no_response_is_null_or_zero(spark):
    imps, bids = [imp(1)], [(1, H[1], 0, 3)]
    assert measures(run(spark, "agg_display_rtb", imps, bids, [])) == [(1, None)]
    assert measures(run(spark, "agg_auction_features", imps, bids, [])) == [(1, 0)]


def test_click_window_is_two_hours_and_conversion_window_a_day(spark):
    imps, bids = [imp(1)], [(1, H[1], 0, 3)]
    late = [(1, H[0]), (1, H[1]), (1, H[2]), (1, H[3])]
    assert measures(run(spark, "agg_display_rtb", imps, bids, late)) == [(2, 2)]
    convs = [(1, H[1], 1), (1, "2024-03-11 00", 1), (1, "2024-03-11 01", 1), (1, H[5], 0)]
    assert measures(run(spark, "agg_conversions_seller", imps, bids, convs)) == [(2, 2)]


def test_hours_that_no_local_clock_has(spark):
    """02:00 does not exist on this day in the session's time zone."""
    imps, bids = [imp(1, dh=H[1]), imp(2, dh=H[2])], [(1, H[1], 0, 3), (2, H[2], 0, 3)]
    clicks = [(1, H[2]), (2, H[3])]
    assert sorted(measures(run(spark, "agg_display_rtb", imps, bids, clicks))) == [(1, 1), (1, 1)]


def test_bid_of_another_hour_or_auctions_without_id_do_not_match(spark):
    imps = [imp(1), imp(None)]
    bids = [(1, H[2], 0, 3), (None, H[1], 0, 3)]
    assert measures(run(spark, "agg_display_rtb", imps, bids, [])) == []


def test_null_seller_and_excluded_members_are_dropped_null_keys_kept(spark):
    imps = [imp(1, seller=None), imp(2, seller=332), imp(3, seller=818), imp(4, site_domain=None)]
    bids = [(a, H[1], 0, 3) for a in (1, 2, 3, 4)]
    got = run(spark, "agg_display_os", imps, bids, []).select("site_domain", "seller_member_id").collect()
    assert [tuple(r) for r in got] == [(None, 7)]
    app = [imp(a, supply=2, seller=s) for a, s in ((1, 332), (3, 818))]
    assert measures(run(spark, "agg_mobile_app_size", app, bids, [])) == [(1, None)]
    assert measures(run(spark, "agg_mobile_app", app, bids, [])) == []


def test_listed_hours_only(spark):
    imps = [imp(1, dh=H[1]), imp(2, dh=H[5]), imp(3, dh=H[6])]
    bids = [(1, H[1], 0, 3), (2, H[5], 0, 3), (3, H[6], 0, 3)]
    clicks = [(2, H[6]), (3, H[8])]
    got = run(spark, "agg_display_rtb", imps, bids, clicks, hours=[H[5], H[6]])
    assert sorted((r["dh"], r["imps"], r["clicks"]) for r in got.collect()) == [(H[5], 1, 1), (H[6], 1, None)]


def test_chosen_campaigns(spark):
    imps = [imp(1), imp(2)]
    bids = [(1, H[1], 4, 3), (1, H[1], 0, 8), (2, H[1], 3, 8)]
    chosen = spark.createDataFrame([(3,), (3,)], "campaign_id int")
    got = run(spark, "agg_campaign_clicks", imps, bids, [(1, H[2])], campaigns=chosen)
    assert [(r["campaign_id"], r["size"], r["imps"], r["clicks"]) for r in got.collect()] == [(3, 75000, 1, 1)]
    with pytest.raises(ValueError):
        run(spark, "agg_campaign_clicks", imps, bids, [])


def test_empty_inputs(spark):
    assert measures(run(spark, "agg_display_rtb", [], [], [])) == []


def brute(imps, bids, clicks, once):
    out = defaultdict(lambda: [0, None])
    for i in imps:
        found = [b for b in bids if b[:2] == i[:2] and b[2] == 0 and b[3] > 0]
        hits = sum(c[0] == i[0] and i[1] <= c[1] <= add_hours(i[1], 1) for c in clicks)
        n = min(len(found), 1) if once else len(found)
        if n:
            cell = out[(i[1], i[6])]
            cell[0] += n * max(1, hits)
            cell[1] = (cell[1] or 0) + n * hits if hits else cell[1]
    return sorted((k, tuple(v)) for k, v in out.items())


def hot_logs(seed, n=400):
    """A third of all impressions, bids and clicks belong to one auction."""
    rng = random.Random(seed)

    def auction():
        return 1 if rng.random() < 1 / 3 else rng.randrange(2, 60)

    imps = [imp(auction(), dh=rng.choice(H[1:4]), width=rng.randrange(3)) for _ in range(n)]
    bids = [(auction(), rng.choice(H[1:4]), 0, rng.randrange(5)) for _ in range(n // 2)]
    clicks = [(auction(), rng.choice(H[1:6])) for _ in range(n // 2)]
    return imps, bids, clicks


@pytest.mark.parametrize("seed,name", list(itertools.product((1, 2), ("agg_display_rtb", "agg_display_os"))))
def test_hot_auction_equals_brute_force(spark, seed, name):
    imps, bids, clicks = hot_logs(seed)
    got = run(spark, name, imps, bids, clicks).groupBy("dh", "width").agg({"imps": "sum", "clicks": "sum"})
    found = sorted(((r[0], r[1]), (r["sum(imps)"], r["sum(clicks)"])) for r in got.collect())
    assert found == brute(imps, bids, clicks, hourly.JOBS[name].bid_once)


def test_hot_auction_is_split_over_tasks(spark, conf, tmp_path):
    """With the thresholds scaled down, the join of the impression log is a skew join."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    imps, bids, clicks = hot_logs(3, 3000)
    stored = str(tmp_path / "imps")
    spark.createDataFrame(imps, IMP).repartition(12).write.parquet(stored)
    df = hourly.hourly_aggregate(
        "agg_display_rtb", spark.read.parquet(stored), spark.createDataFrame(bids, BID),
        spark.createDataFrame(clicks, "auction_id_64 bigint, dh string"),
    )
    total = sum(r["imps"] for r in df.collect())
    assert total == sum(v[0] for _, v in brute(imps, bids, clicks, False))
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_four_way_equals_the_single_jobs(spark):
    rng = random.Random(5)
    imps = [
        imp(rng.randrange(40), dh=rng.choice(H[1:3]), supply=rng.randrange(4), device_type=rng.randrange(2),
            device_id=rng.randrange(2), content_category_id=rng.randrange(2))
        for _ in range(300)
    ]
    bids = [(rng.randrange(40), rng.choice(H[1:3]), rng.choice([0, 2, 3]), rng.randrange(3)) for _ in range(80)]
    clicks = [(rng.randrange(40), rng.choice(H[1:5])) for _ in range(60)]
    frames = [spark.createDataFrame(imps, IMP), spark.createDataFrame(bids, BID),
              spark.createDataFrame(clicks, "auction_id_64 bigint, dh string")]
    long = hourly.four_way_aggregate(*frames)
    for target in hourly.FOUR_WAY:
        assert rows(hourly.one_target(long, target)) == rows(hourly.hourly_aggregate(target, *frames))


def test_tree_campaign_rows(spark):
    imps = spark.createDataFrame([imp(1), imp(2)], IMP)
    bids = spark.createDataFrame([(1, H[1], 0, 3), (2, H[1], 0, 4)], BID)
    pixels = spark.createDataFrame(
        [(1, H[1], 3, 50), (1, H[9], 3, 51), (1, H[0], 3, 52), (1, H[2], 4, 53)],
        "auction_id_64 bigint, dh string, campaign_id int, pixel_id int",
    )
    models = spark.createDataFrame([(10, 3, 0), (11, 4, 1)], "bid_model_id int, campaign_id int, deleted int")
    campaigns = spark.createDataFrame([(3, 0, "active"), (4, 0, "active")], "id int, deleted int, state string")
    chosen = hourly.tree_campaigns(models, campaigns)
    assert rows(chosen) == [(10, 3)]
    got = hourly.tree_campaign_imps(imps, bids, pixels, chosen, H[4])
    assert [(r["auction_id_64"], r["campaign_id"], r["pixel_id"]) for r in got.collect()] == [(1, 3, 50)]


def test_a_million_copies_are_written_in_blocks(spark):
    imps = spark.createDataFrame([imp(1), imp(2)], IMP)
    many = spark.range(1000).selectExpr("CAST(1 AS BIGINT) AS auction_id_64", f"'{H[1]}' AS dh", "3 AS campaign_id")
    bids = many.withColumn("payment_type", F.lit(0)).unionByName(spark.createDataFrame([(2, H[1], 0, 3)], BID))
    pixels = many.withColumn("pixel_id", F.lit(50))
    chosen = spark.createDataFrame([(3,)], "campaign_id int")
    got = hourly.tree_campaign_imps(imps, bids, pixels, chosen, H[4])
    counts = {(r["auction_id_64"], r["pixel_id"]): r["count"] for r in got.groupBy("auction_id_64", "pixel_id").count().collect()}
    assert counts == {(1, 50): 1_000_000, (2, None): 1}


def test_hot_campaign_is_split_over_tasks(spark, conf, tmp_path):
    """Bids are counted before they meet a campaign list that is too long to broadcast."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    # Every third bid is of campaign 1.
    bids = spark.range(12000).selectExpr(
        "id AS auction_id_64", f"'{H[1]}' AS dh", "0 AS payment_type",
        "CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 2 + id % 500 END AS INT) AS campaign_id",
    )
    bids.union(bids.where("auction_id_64 < 50")).repartition(12).write.parquet(str(tmp_path / "bids"))
    imps = spark.createDataFrame([imp(a) for a in range(0, 600)], IMP)
    chosen = spark.createDataFrame([(c,) for c in range(1, 400)], "campaign_id int")
    df = hourly.hourly_aggregate(
        "agg_campaign_clicks", imps, spark.read.parquet(str(tmp_path / "bids")),
        spark.createDataFrame([(0, H[1]), (0, H[2])], "auction_id_64 bigint, dh string"), chosen,
    )
    total = {r["campaign_id"]: r["imps"] for r in df.groupBy("campaign_id").agg(F.sum("imps").alias("imps")).collect()}
    assert total[1] == 200 + 17 + 2  # twice the bids up to 50, and two clicks on both bids of auction 0
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(skew=true\) \[campaign_id", text)


@pytest.mark.parametrize("name", ["agg_display_rtb", "agg_conversions_seller"])
def test_responses_are_not_multiplied_by_hours(spark, name):
    schema = "auction_id_64 bigint, dh string, post_click_conv int"
    df = hourly.hourly_aggregate(
        name, spark.createDataFrame([], IMP), spark.createDataFrame([], BID), spark.createDataFrame([], schema)
    )
    assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tree_rows_shuffle_the_wide_log_once(spark, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    spark.createDataFrame([imp(1)], IMP).write.parquet(str(tmp_path / "imps"))
    bids = spark.createDataFrame([(1, H[1], 0, 3)], BID)
    pixels = spark.createDataFrame([(1, H[1], 3, 50)], "auction_id_64 bigint, dh string, campaign_id int, pixel_id int")
    chosen = spark.createDataFrame([(3,)], "campaign_id int")
    df = hourly.tree_campaign_imps(spark.read.parquet(str(tmp_path / "imps")), bids, pixels, chosen, H[4])
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    indent = lambda line: re.search(r"[A-Z*]", line).start()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    above, depth = 0, indent(lines[scan])
    for line in reversed(lines[:scan]):
        if indent(line) < depth:
            depth = indent(line)
            above += "Exchange" in line
    assert above == 1


def test_day_rollup_drops_null_keys_and_fills_zero(spark):
    hours = spark.createDataFrame(
        [("2024-01-01 00", "a", 2, None), ("2024-01-01 05", "a", 3, None), ("2024-01-01 05", "b", 1, 1),
         ("2024-01-01 06", None, 9, 9)],
        "dh string, k string, imps bigint, clicks bigint",
    )
    assert rows(hourly.day_rollup(hours, ["k"])) == [("2024-01-01", "a", 5, 0), ("2024-01-01", "b", 1, 1)]
