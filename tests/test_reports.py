"""Reporting, lookups, goals and metadata on hand-made rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from auctionlens.functions import predicates, timeparts
from auctionlens.operators import campaign_meta, clog, goals, lookups, reporting


def test_size_function_agrees_with_its_predicates(spark):
    sizes = [(300, 250), (300, 600), (54, 132), (266, 127), (60, 120), (728, 90), (1, 1), (74000, 1), (90000, 1), (90001, 1)]
    df = spark.createDataFrame(sizes, "width int, height int")
    for bucket in range(1, 7):
        got = df.select(
            (predicates.size_bucket(predicates.size_area()) == bucket).alias("f"),
            predicates.in_size_bucket(bucket).alias("p"),
        ).collect()
        assert all(r["f"] == r["p"] for r in got)
    unknown = spark.createDataFrame([(None, 5)], "width int, height int")
    assert unknown.select(predicates.size_bucket(predicates.size_area())).first()[0] == 1
    assert spark.createDataFrame([(0, 0)], "width int, height int").where(predicates.in_size_bucket(0)).count() == 1
    with pytest.raises(ValueError):
        predicates.in_size_bucket(7)
    with pytest.raises(ValueError):
        predicates.sized(300, "all")


def test_hours(spark):
    df = spark.createDataFrame([("2024-03-10 01",), ("2023-12-31 23",)], "dh string")
    moved = df.select(timeparts.shift_hour(F.col("dh"), 1), timeparts.shift_hour(F.col("dh"), -2)).collect()
    assert [tuple(r) for r in moved] == [("2024-03-10 02", "2024-03-09 23"), ("2024-01-01 00", "2023-12-31 21")]
    parts = timeparts.with_partition_parts(df).first()
    assert (parts["dy"], parts["dm"], parts["dd"]) == ("2024", "2024-03", "2024-03-10")
    assert timeparts.hours_of_day("2024-01-01")[23] == "2024-01-01 23"
    stamp = spark.range(1).select(timeparts.truncate_to_hour(F.lit("2024-01-01 05:44:10"))).first()[0]
    assert stamp == "2024-01-01 05:00:00"


def test_looking_back(spark):
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "ymd string")
    assert days.where(timeparts.looking_back("ymd", "2024-01-08", 7)).count() == 2
    assert days.where(timeparts.looking_back("ymd", "2024-01-08", 7, strict=True)).count() == 1
    assert days.where(timeparts.looking_back("ymd", "2024-01-08 10:00:00", 7)).count() == 1


FACT = (
    "ymd string, seller_member_id int, site_id int, geo_country string, width int, height int, campaign_group_id int, "
    "imp_type int, revenue_type int, predict_type_rev int, imps bigint, booked_revenue_dollars decimal(18,4), "
    "reseller_revenue decimal(18,4)"
)


def fact(spark, *records):
    from decimal import Decimal

    full = [
        ("2024-01-01", 1, site, "US", 300, 250, cg, imp, rev, pred, imps, Decimal(2), Decimal(1))
        for site, cg, imp, rev, pred, imps in records
    ]
    return spark.createDataFrame(full, FACT)


def test_site_stats_classes(spark):
    table = fact(
        spark,
        (1, 1, 5, 3, 0, 60), (1, 1, 6, 4, 1, 50), (1, 1, 5, 0, 0, 7), (1, 1, 7, 3, 0, 999), (1, 1, 5, 3, None, 1),
        (2, 1, 5, 3, 0, 100),
    )
    market = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 1, 1)], "site_id int, deleted int, performance int")
    (row,) = reporting.site_daily_stats(table, market).collect()
    got = {c: row[c] for c in ("site_id", "in_programme", "imps", "perf_imps", "perf_managed_imps", "perf_xnet_imps",
                               "learn_imps", "learn_managed_imps", "learn_xnet_imps")}
    assert got == dict(site_id=1, in_programme=1, imps=118, perf_imps=111, perf_managed_imps=61, perf_xnet_imps=50,
                       learn_imps=110, learn_managed_imps=60, learn_xnet_imps=50)
    assert (float(row["revenue"]), float(row["perf_rev"]), float(row["learn_rev"])) == (12.0, 9.0, 4.0)


def test_ratios_divide_by_zero_to_null(spark):
    columns = [f"{c}_{m}" for c in ("total", "perf", "perf_managed", "perf_xnet") for m in ("imps", "revenue")]
    df = spark.createDataFrame(
        [("a", 10, 5.0, 10, 5.0, 0, 0.0, 0, 0.0, 4, 2.0), (None, 10, 5.0, 10, 5.0, 0, 0.0, 0, 0.0, 4, 2.0)],
        "k string, " + ", ".join(f"{c} {'bigint' if c.endswith('imps') else 'double'}" for c in columns)
        + ", learn_imps bigint, learn_rev double",
    )
    (row,) = reporting.perf_ratios(df, ["k"]).collect()
    assert (row["learn_pct"], row["perf_rpm"], row["perf_managed_rpm"], row["flat_cpm_rpm"]) == (0.4, 500.0, None, None)
    assert (row["flat_cpm_imps"], row["learn_rpm"]) == (0, 500.0)


def test_learn_share_is_read_by_time_then_size(spark):
    report = spark.createDataFrame(
        [("2024-01-02", "2024-01-02 00", 9), ("2024-01-01", "2024-01-01 07", 3), ("2024-01-01", "2024-01-01 02", 5),
         ("2024-01-01", "2024-01-01 02", 8)],
        "ymd string, ymdh string, imps bigint",
    )
    assert [r["imps"] for r in reporting.sorted_learn_share(report).collect()] == [8, 5, 3, 9]
    assert [r["imps"] for r in reporting.sorted_learn_share(report, hourly=True).collect()] == [8, 5, 3, 9]
    late = report.where("imps <> 8").union(report.selectExpr("ymd", "'2024-01-01 01'", "1L"))
    assert [r["imps"] for r in reporting.sorted_learn_share(late, hourly=True).collect()] == [1, 1, 1, 1, 5, 3, 9]


def test_country_default_and_case(spark):
    country = spark.createDataFrame([(1, "US", 4), (2, "US", 5), (3, "FR", 6)], "id int, code string, country_group_id int")
    df = spark.createDataFrame([("US",), ("us",), ("XX",), (None,)], "geo_country string")
    assert dict(rows(lookups.with_country_group(df, country))) == {"US": "5", "us": "", "XX": "", None: ""}
    assert dict(rows(lookups.with_country_group(df, country, upper=True)))["us"] == "5"


SITE = "id int, member_id int, publisher_id int, managed_bucket_id int, deleted int, state string"


def test_sites(spark):
    site = spark.createDataFrame(
        [(1, 5, 9, 70, 0, "active"), (2, 958, 9, 70, 0, "active"), (3, 5, 8, 71, 1, "active"), (4, 5, 8, 70, 0, "inactive")],
        SITE,
    )
    market = spark.createDataFrame(
        [(i, f"2024-01-0{i}", "2024-02-01 10:00:00", 0, 1) for i in (1, 2, 3, 4)],
        "site_id int, created_on string, last_modified string, deleted int, performance int",
    )
    assert [r["site_id"] for r in lookups.newest_first(lookups.programme_sites(site, market)).collect()] == [4, 1]
    assert rows(lookups.programme_sites_of_member(site, market, 5, "2024-01-02").select("site_id")) == [(4,)]
    wanted = spark.createDataFrame([(1,)], "site_id int")
    assert rows(lookups.site_closure(site, market, wanted)) == [(1, 70), (2, 70), (4, 70)]
    publishers = spark.createDataFrame([(8,)], "publisher_id int")
    assert rows(lookups.sites_of_publishers(site, publishers)) == [(3,), (4,)]


def test_clogged_nodes(spark):
    table = fact(spark, (1, 1, 5, 3, 0, 5), (1, 0, 5, 3, 0, 5))
    site = spark.createDataFrame([(1, 5, 9, 70, 0, "active")], SITE)
    country = spark.createDataFrame([(1, "US", 4)], "id int, code string, country_group_id int")
    sizes = spark.createDataFrame([(2, 300, 250, 0, 1)], "id int, width int, height int, deleted int, active int")
    groups = spark.createDataFrame([(1, 5), (2, 5), (0, 5), (3, 6)], "id int, member_id int")
    offers = spark.createDataFrame(
        [(1, 5, 70, 4, 2, 0, 0), (1, 5, 70, 4, 2, 0, 0), (2, 5, 70, 4, 2, 0, 0), (0, 5, 70, 4, 2, 0, 0),
         (3, 5, 70, 4, 2, 0, 0), (2, 5, 70, 4, 2, 0, 1), (2, 5, 70, 4, 2, 1, 0)],
        "campaign_group_id int, bucket_member_id int, bucket_id int, country_group_id int, creative_size_bucket_id int, "
        "deleted int, opt_state int",
    )
    sites = spark.createDataFrame([(1,)], "site_id int")
    report = clog.clogged_nodes(table, sites, offers, site, country, sizes, groups, "2024-01-03", 7)
    # Line item 0 does not count as an offer although it has impressions.
    assert rows(clog.most_clogged_first(report)) == [(70, 4, 2, 3, 3, 0)]


def test_line_item_goals(spark):
    groups = spark.createDataFrame(
        [(1, "ctr", 0, 0), (2, "ctr", 0, 0), (3, "cpc", 0, 0), (4, "cpa", 0, 0), (5, "cpa", 0, 0), (6, "cpa", 0, 1),
         (7, "ctr", 0, 0)],
        "id int, goal_type string, revenue_type int, deleted int",
    )
    values = spark.createDataFrame(
        [(1, 0.1, 0), (2, 0.2, 1), (3, 0.3, 1), (7, None, 0), (1, 0.4, None)],
        "campaign_group_id int, goal_threshold double, deleted int",
    )
    goal = spark.createDataFrame(
        [(4, 50, 1.0, None, 0), (4, 51, None, None, 0), (5, 52, 1.0, 2.0, 1), (3, 53, None, 1.0, 0)],
        "campaign_group_id int, pixel_id int, post_view_goal_threshold double, post_click_goal_threshold double, deleted int",
    )
    got = goals.line_item_goals(groups, values, goal)
    assert rows(got.select("cg_id", "goal_threshold", "pixel_id", "pvg_threshold", "pcg_threshold")) == [
        (1, 0.1, None, None, None), (1, 0.4, None, None, None), (3, 0.3, 53, None, 1.0), (4, None, 50, 1.0, None),
    ]
    assert rows(goals.conform_line_items(got)) == [
        (1, "ctr", 0.1, 0), (1, "ctr", 0.4, 0), (3, "cpc", 0.3, 0), (4, "cpa_post_view", 1.0, 50),
    ]
    assert rows(goals.goal_pixels(got)) == [(4, 50)]


def test_latest_exclusion_wins(spark):
    table = spark.createDataFrame(
        [(1, 1, 1, 1, 2, 1, "2024-01-01 05:30:00", 1), (1, 1, 1, 1, 3, 1, "2024-01-01 06:30:00", 2),
         (1, 1, 1, 1, 1, 1, "2024-01-01 07:30:00", 3), (1, 1, 2, 1, 2, 1, "2024-01-01 06:10:00", 4),
         (1, 1, 3, 1, 2, 0, "2024-01-01 06:10:00", 5), (1, 1, 4, 1, 2, 1, "2024-01-02 00:00:00", 6)],
        "campaign_group_id int, country_group_id int, tag_id int, creative_size_bucket_id int, exclusion_state_id int, "
        "active int, last_modified string, id bigint",
    )
    got = goals.exclusion_counts(table, "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    assert rows(got) == [("2024-01-01 06:00:00", 1, 1, 1)]


def test_campaign_metadata(spark):
    pixel = spark.createDataFrame([(1, "hybrid", 0, "active"), (2, "view", 0, "active")],
                                  "id int, trigger_type string, deleted int, state string")
    links = spark.createDataFrame([(1, 10, 2.0, 4.0, 0, "active"), (2, 10, 6.0, 8.0, 0, "active")],
                                  "pixel_id int, campaign_group_id int, post_view_revenue double, "
                                  "post_click_revenue double, deleted int, state string")
    groups = spark.createDataFrame([(10, "EUR", 0, "active")], "id int, currency string, deleted int, state string")
    camps = spark.createDataFrame([(100, 10, 0, "active"), (101, 10, 1, "active")],
                                  "id int, campaign_group_id int, deleted int, state string")
    rates = spark.createDataFrame([("EUR", 0.5)], "code string, conversion_rate double")
    paid = spark.createDataFrame(
        [(100, 1, "advertiser_goal", "pc_cpa", 3.0), (100, 1, "rtb_cpm_payout", "pc_cpa", 1.0),
         (100, 1, "rtb_cpm_payout", "pc_cpa", 1.5), (100, 1, "other", "pc_cpa", 9.0), (100, 1, "advertiser_goal", "x", 9.0)],
        "campaign_id int, pixel_id int, type string, value_type string, value double",
    )
    goal = spark.createDataFrame([(10, 1, 7.0, None, "active")],
                                 "campaign_group_id int, pixel_id int, post_view_goal_target double, "
                                 "post_click_goal_target double, state string")
    got = campaign_meta.campaign_pixel_meta(pixel, links, groups, camps, rates, paid, goal)
    assert rows(got) == [
        (10, 100, 1, "click", 8.0, 6.0, 5.0, None), (10, 100, 1, "view", 4.0, None, None, 14.0),
        (10, 100, 2, "view", 12.0, None, None, None),
    ]


def test_campaigns_meet_pixels_after_all_shuffles(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    state = "deleted int, state string"
    pixel = spark.range(50).selectExpr("int(id) AS id", "'hybrid' AS trigger_type", "0 AS deleted", "'active' AS state")
    links = spark.range(50).selectExpr("id AS pixel_id", "1 AS campaign_group_id", "2D AS post_view_revenue",
                                       "4D AS post_click_revenue", "0 AS deleted", "'active' AS state")
    groups = spark.createDataFrame([(1, "EUR", 0, "active")], f"id int, currency string, {state}")
    camps = spark.range(20).selectExpr("int(id) AS id", "1 AS campaign_group_id", "0 AS deleted", "'active' AS state")
    rates = spark.createDataFrame([("EUR", 0.5)], "code string, conversion_rate double")
    paid = spark.createDataFrame([(3, 7, "advertiser_goal", "pc_cpa", 1.0), (3, 8, "rtb_cpm_payout", "pv_cpa", 2.0)],
                                 "campaign_id int, pixel_id int, type string, value_type string, value double")
    goal = spark.createDataFrame([(1, 9, 3.0, None, "active")], "campaign_group_id int, pixel_id int, "
                                 "post_view_goal_target double, post_click_goal_target double, state string")
    got = campaign_meta.campaign_pixel_meta(pixel, links, groups, camps, rates, paid, goal)
    assert rows(got) == sorted(
        ((1, c, p, kind, revenue, 2.0 if (c, p, kind) == (3, 7, "click") else None,
          4.0 if (c, p, kind) == (3, 8, "view") else None, 6.0 if (p, kind) == (9, "view") else None)
         for c in range(20) for p in range(50) for kind, revenue in (("view", 4.0), ("click", 8.0))),
        key=lambda t: t[:4],
    )
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    joins, shuffles = ([i for i, line in enumerate(plan) if kind in line] for kind in ("Join", "Exchange"))
    assert "part" in plan[joins[0]] and joins[0] < shuffles[0] < joins[1]


def test_the_product_of_a_large_group_is_stored_small(spark, conf, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    state = ("0 AS deleted", "'active' AS state")
    pixel = spark.range(24).selectExpr("int(id) AS id", "'view' AS trigger_type", *state)
    links = spark.range(24).selectExpr("int(id) AS pixel_id", "1 AS campaign_group_id", "2D AS post_view_revenue",
                                       "4D AS post_click_revenue", *state)
    groups = spark.range(1).selectExpr("1 AS id", "'EUR' AS currency", *state)
    # 20,003 campaigns; one is there twice, one has no id, one no group.
    camps = spark.range(20_003).selectExpr("int(nullif(id * 7, 21)) AS id", "1 AS campaign_group_id", *state).union(
        spark.sql("SELECT 7, 1, 0, 'active' UNION ALL SELECT 1, CAST(NULL AS INT), 0, 'active'")
    )
    rates = spark.createDataFrame([("EUR", 0.5)], "code string, conversion_rate double")
    paid = spark.createDataFrame([(7, 5, "advertiser_goal", "pv_cpa", 1.0), (7, 5, "rtb_cpm_payout", "pv_cpa", 2.0)],
                                 "campaign_id int, pixel_id int, type string, value_type string, value double")
    goal = spark.createDataFrame([(1, 9, 3.0, None, "active")], "campaign_group_id int, pixel_id int, "
                                 "post_view_goal_target double, post_click_goal_target double, state string")
    campaign_meta.campaign_pixel_meta(pixel, links, groups, camps, rates, paid, goal).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 20_004 * 24
    assert rows(got.groupBy("campaign_id").count().where("count <> 24")) == [(7, 48)]
    assert rows(got.where("campaign_id IS NULL AND pixel_id < 2").drop("campaign_id")) == [
        (1, p, "view", 4.0, None, None, None) for p in range(2)
    ]
    assert rows(got.where("adv_goal IS NOT NULL OR rtb_cpm_payout IS NOT NULL")) == 2 * [
        (1, 7, 5, "view", 4.0, 2.0, 4.0, None)
    ]
    assert got.where("goal_target = 6 AND pixel_id = 9").count() == got.where("goal_target IS NOT NULL").count() == 20_004
    stored = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert stored < 2 * 20_004 * 24  # an id of four bytes alone would be twice that


def test_campaigns_by_target(spark):
    camps = spark.createDataFrame([(1, 10, 5), (2, 10, None), (3, 11, 0), (4, None, 6), (5, 10, 6)],
                                  "id int, campaign_group_id int, profile_id int")
    groups = spark.createDataFrame([(10, 7), (11, 0)], "id int, profile_id int")
    target = "profile_id int, deleted int"
    first = spark.createDataFrame([(5, 0), (0, 0)], target)
    second = spark.createDataFrame([(6, 0), (7, 1)], target)
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "campaign_id int")
    assert rows(campaign_meta.campaigns_by_target(camps, groups, wanted, [first, second])) == [(1,), (4,)]
