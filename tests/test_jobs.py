"""Whole runs over the smallest tables."""

import pytest
from conftest import rows

from auctionlens.operators import hourly
from auctionlens.plans import jobs
from auctionlens.schemas import HOURLY_TABLES, create_table
from auctionlens.sources import readers, sinks
from auctionlens.sources.fixtures import fixture_catalog

DAY = "2024-01-01"


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_catalog(spark, "/root/testdata/sf0.001")


def test_due_days():
    assert jobs.due_day("agg_display_rtb", "2024-03-02") == "2024-03-01"
    assert jobs.due_day("agg_conversions_seller", "2024-03-02") == "2024-02-29"


def test_day_run_stores_the_aggregate(spark, tables, tmp_path):
    path = str(tmp_path / "os")
    for _ in range(2):
        jobs.aggregate_day(tables, "agg_display_os", DAY, path)
    stored = readers.read_hourly(spark, path, HOURLY_TABLES["agg_display_os"])
    whole = hourly.hourly_aggregate("agg_display_os", tables["imps"], tables["bids"], tables["clicks"])
    assert rows(stored.select(whole.columns)) == rows(whole)
    assert len(list((tmp_path / "os" / "dd=2024-01-01").iterdir())) <= 24
    jobs.export_day(stored, "hourly_export_web", DAY, str(tmp_path / "text"))
    assert len([p for p in (tmp_path / "text").iterdir() if p.name.startswith("hh=")]) == whole.select("dh").distinct().count()
    day = jobs.day_table(stored, "hourly_export_web", DAY, str(tmp_path / "day"))
    assert day.agg({"imps": "sum"}).first()[0] == whole.agg({"imps": "sum"}).first()[0]


def test_campaign_jobs_choose_their_campaigns(spark, tables, tmp_path):
    path = str(tmp_path / "camp")
    jobs.aggregate_day(tables, "agg_campaign_clicks", DAY, path, min_imps=600)
    stored = readers.read_hourly(spark, path, HOURLY_TABLES["agg_campaign_clicks"])
    big = {r["campaign_id"] for r in jobs.chosen_campaigns("agg_campaign_clicks", tables, 600).collect()}
    found = {r["campaign_id"] for r in stored.collect()}
    assert found and found <= big
    assert jobs.chosen_campaigns("agg_social", tables) is None


def test_backfill_run(spark, tables, tmp_path):
    path = str(tmp_path / "features")
    hours = jobs.aggregate_ready_hours(tables, "2024-01-02 00", path)
    assert len(hours) == 18 and hours[0] == "2024-01-01 06"
    schema = HOURLY_TABLES["agg_auction_features"]
    assert readers.read_hourly(spark, path, schema).select("dd").distinct().count() == 1
    found = hourly.hourly_aggregate("agg_auction_features", tables["imps"], tables["bids"], tables["clicks"]).schema
    assert {f.name: f.dataType for f in found} == {f.name: f.dataType for f in schema if f.name != "dd"}
    assert jobs.aggregate_ready_hours(tables, "2025-01-01", str(tmp_path / "none")) == []


def test_other_runs(spark, tables, tmp_path):
    jobs.aggregate_four_way_day(tables, DAY, str(tmp_path / "four"))
    four = sinks.read_four_way(spark, str(tmp_path / "four"))
    assert all(four[t].count() for t in hourly.FOUR_WAY)
    jobs.write_tree_campaign_imps(tables, "2024-01-01 05", "2024-01-01 23", str(tmp_path / "tree"))
    assert spark.read.parquet(str(tmp_path / "tree")).count() > 0
    jobs.write_site_stats(tables, "1999-01-05", str(tmp_path / "sites"), 20)
    assert spark.read.parquet(str(tmp_path / "sites")).count() > 0
    jobs.write_campaign_meta(tables, "2024-01-01 05:10:00", str(tmp_path / "meta"))
    assert (tmp_path / "meta/dy=2024/dm=2024-01/dd=2024-01-01/dh=2024-01-01 05").is_dir()


def test_counted_tree_rows_hold_the_same(tables):
    chosen = hourly.tree_campaigns(tables["bid_model"], tables["campaign"])
    args = (tables["imps"], tables["bids"], tables["pixel_fires"], chosen, "2024-01-02 01")
    counted = hourly.tree_campaign_imps(*args, counted=True)
    assert counted.agg({"copies": "sum"}).first()[0] == hourly.tree_campaign_imps(*args).count()


def test_partition_hours(spark):
    create_table(spark, "listed", HOURLY_TABLES["agg_social"])
    for hour in ("2024-01-01 00", "2024-01-01 07"):
        spark.sql(f"ALTER TABLE listed ADD PARTITION (dd = '2024-01-01', dh = '{hour}')")
    assert rows(readers.partition_hours(spark, "listed")) == [("2024-01-01 00",), ("2024-01-01 07",)]
    spark.sql("DROP TABLE listed")
