"""Sources and sinks on small files."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from auctionlens.operators import backfill, hourly
from auctionlens.plans import jobs
from auctionlens.schemas import CAMPAIGN_PIXEL_META, HOURLY_TABLES, create_table
from auctionlens.sources import readers, sinks
from auctionlens.sources.catalog import Catalog

SOCIAL = "operating_system string, width int, height int, geo_country string, imps bigint, clicks bigint, dh string"


def social(spark, hours, imps=1):
    return spark.createDataFrame([("1", 300, 250, "US", imps, None, h) for h in hours], SOCIAL)


def test_hourly_overwrite_replaces_only_its_hours(spark, tmp_path):
    path = str(tmp_path / "agg")
    sinks.write_hours(social(spark, ["2024-01-01 00", "2024-01-01 05"]), path)
    for _ in range(2):
        sinks.write_hours(social(spark, ["2024-01-01 05"], 7), path)
    table = readers.read_hourly(spark, path, HOURLY_TABLES["agg_social"])
    assert rows(table.select("dd", "dh", "imps")) == [
        ("2024-01-01", "2024-01-01 00", 1), ("2024-01-01", "2024-01-01 05", 7),
    ]
    one = readers.read_hourly(spark, path, HOURLY_TABLES["agg_social"], ["2024-01-01 05"])
    assert [r["imps"] for r in one.collect()] == [7]
    (filters,) = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", one._jdf.queryExecution().toString())
    assert "2024-01-01 05" in filters


def test_deep_partitions_and_compression(spark, tmp_path):
    path = str(tmp_path / "deep")
    sinks.write_hours(social(spark, ["2024-01-01 05"]), path, deep=True, compression="gzip")
    files = list((tmp_path / "deep/dy=2024/dm=2024-01/dd=2024-01-01/dh=2024-01-01 05").glob("*.gz.parquet"))
    assert len(files) == 1


def test_four_way_write_gives_four_tables(spark, tmp_path):
    schema = (
        "auction_id_64 bigint, dh string, operating_system string, supply_type int, device_type int, device_id int, "
        "width int, height int, content_category_id int, site_domain string, application_id string, "
        "geo_country string, seller_member_id int, buyer_member_id int"
    )
    imps = spark.createDataFrame(
        [(i, "2024-01-01 03", "1", i % 4, 0, 1, 300, 250, 1, "s", "a", "US", 7, 9) for i in range(8)], schema
    )
    bids = spark.createDataFrame(
        [(i, "2024-01-01 03", 0, 1) for i in range(8)], "auction_id_64 bigint, dh string, payment_type int, campaign_id int"
    )
    clicks = spark.createDataFrame([(1, "2024-01-01 04")], "auction_id_64 bigint, dh string")
    long = hourly.four_way_aggregate(imps, bids, clicks)
    path = str(tmp_path / "four")
    for _ in range(2):
        sinks.write_four_way(long, path)
    stored = sinks.read_four_way(spark, path)
    for target in hourly.FOUR_WAY:
        assert rows(stored[target]) == rows(hourly.one_target(long, target))


def test_daily_table_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "days")
    day = spark.createDataFrame([("2024-01-01", 5), ("2024-01-02", 6)], "ymd string, site_id int")
    for _ in range(2):
        sinks.write_days(day, path)
    assert spark.read.parquet(path).count() == 2


def test_meta_tsv(spark, tmp_path):
    meta = spark.createDataFrame(
        [(1, 2, 3, "view", 0.5, None, 1.5, 2.5)],
        "campaign_group_id int, campaign_id int, pixel_id int, trigger_type string, revenue float, adv_goal float, "
        "rtb_cpm_payout float, goal_target float",
    )
    path = str(tmp_path / "meta")
    sinks.write_meta_tsv(meta, path, "2024-01-01 05")
    (file,) = (tmp_path / "meta/dy=2024/dm=2024-01/dd=2024-01-01/dh=2024-01-01 05").glob("*.csv")
    assert file.read_text() == "1\t2\t3\tview\t0.5\t\t1.5\t2.5\n"
    back = readers.read_tsv(spark, path, CAMPAIGN_PIXEL_META, header=False).first()
    assert (back["event_type"], back["advertiser_goal"], back["dh"]) == ("view", None, "2024-01-01 05")


def test_day_export_and_tsv_reader(spark, tmp_path):
    path = str(tmp_path / "day")
    table = social(spark, [f"2024-01-01 {h:02d}" for h in (0, 7)])
    export = hourly.hourly_export(table, hourly.EXPORTS["hourly_export_social"][1])
    sinks.export_day(export, path)
    assert {p.name for p in (tmp_path / "day").iterdir() if p.is_dir()} == {"hh=00", "hh=07"}
    back = readers.read_tsv(
        spark, path, "operating_system string, width int, height int, geo_country string, imps bigint, clicks bigint, hh string"
    )
    assert rows(back.select("hh", "imps", "clicks")) == [("00", 1, None), ("07", 1, None)]


def test_tsv_nulls(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('site\timps\n"a\t1\nNULL\tNULL\n')
    assert rows(readers.read_tsv(spark, str(tmp_path / "t.tsv"), "site string, imps int")) == [(None, None), ('"a', 1)]


def test_read_through_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.read_through(spark, str(tmp_path / "cache"), compute).count() == 3
    assert calls == [1]


def test_cache_follows_its_inputs(spark, tmp_path):
    table, cache = str(tmp_path / "agg"), str(tmp_path / "cache")
    kept = lambda: sorted(p.name for p in (tmp_path / "cache").iterdir())
    stored = lambda: readers.read_hourly(spark, table, HOURLY_TABLES["agg_social"])
    total = lambda day="2024-01-01": jobs.day_table(stored(), "hourly_export_social", day, cache).agg({"imps": "sum"}).first()[0]
    sinks.write_hours(social(spark, ["2024-01-01 00", "2024-01-01 05", "2024-01-02 05"]), table)
    assert total() == 2
    first = kept()
    assert total() == 2 and kept() == first and len(first) == 1
    # Another day's hours do not matter, a changed hour of the day does.
    sinks.write_hours(social(spark, ["2024-01-02 05"], 9), table)
    assert total() == 2 and kept() == first
    sinks.write_hours(social(spark, ["2024-01-01 05"], 7), table)
    assert total() == 8 and len(kept()) == 2
    assert total("2024-01-02") == 9 and len(kept()) == 3


def test_fingerprint_is_of_plan_and_rows(spark):
    rows_of = lambda n=4: spark.range(n).selectExpr("id", "id % 2 AS `a.b`")
    plan = lambda df, k="`a.b`": df.groupBy(k).count()
    one = readers.fingerprint(plan(rows_of()), [rows_of()])
    assert one == readers.fingerprint(plan(rows_of()), [rows_of()])
    others = [readers.fingerprint(plan(rows_of()), [rows_of(5)]), readers.fingerprint(plan(rows_of(), "id"), [rows_of()]),
              readers.fingerprint(plan(rows_of()), [rows_of()], "key")]
    assert len({one, *others}) == 4


def test_drop_old_hours(spark):
    create_table(spark, "kept_hours", HOURLY_TABLES["agg_social"])
    hours = ["2024-01-01 00", "2024-01-01 23", "2024-01-02 00"]
    social(spark, hours).withColumn("dd", F.col("dh").substr(1, 10)).select(
        *[f.name for f in HOURLY_TABLES["agg_social"]]
    ).write.insertInto("kept_hours")
    assert sinks.drop_old_hours(spark, "kept_hours", "2024-01-01 23") == ["2024-01-01 00"]
    assert rows(spark.table("kept_hours").select("dh")) == [(h,) for h in hours[1:]]
    assert sinks.drop_old_hours(spark, "kept_hours", "2024-01-01 23") == []
    spark.sql("DROP TABLE kept_hours")


def test_ranges_of_a_snapshot_need_bounds(spark):
    with pytest.raises(ValueError):
        readers.read_snapshot(spark, "jdbc:none", "t", split_on="id", partitions=4)


def test_catalog_renames(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "ids"))
    tables = Catalog(
        spark, {"a": str(tmp_path / "ids"), "b": spark.range(1), "c": lambda s: s.range(4)}, {"a": {"id": "site_id"}}
    )
    assert tables["a"].columns == ["site_id"] and tables["b"].count() == 1 and tables["c"].count() == 4
    assert tables.names() == ["a", "b", "c"] and "d" not in tables


HOURS = "dh string, auction_id_64 bigint"


def hours(spark, *labels):
    return spark.createDataFrame([(h, 1) for h in labels], HOURS)


def test_ready_hours(spark):
    day = [f"2024-01-01 {h:02d}" for h in range(6)]
    imps = hours(spark, "2023-12-20 00", *day)
    bids = hours(spark, "2023-12-20 00", *[h for h in day if h != day[1]])
    clicks = hours(spark, "2023-12-20 00", "2023-12-20 01", *[h for h in day if h != day[4]])
    got = backfill.ready_hours(imps, bids, clicks, hours(spark, day[0]), "2024-01-02 00")
    # 1 has no bids, 3 lacks the next click hour, 4 has no clicks, 5 has no next hour, 0 is done.
    assert rows(got) == [(day[2], day[3])]
    # An hour exactly at the cut-off is too old, one after it is not.
    old = lambda as_of: rows(backfill.ready_hours(imps, bids, clicks, hours(spark), as_of))[0][0]
    assert old("2023-12-28 00") == day[0] and old("2023-12-27 23") == "2023-12-20 00"


def test_retained_and_missing_hours(spark):
    table = hours(spark, "2024-01-01 11", "2024-01-01 12", "2024-01-01 12")
    assert rows(backfill.retained_hours(table, "2024-01-09 12", 8)) == [("2024-01-01 12",)]
    assert rows(backfill.hours_to_load(table, hours(spark, "2024-01-01 12"))) == [("2024-01-01 11",)]
    assert backfill.incremental_rows(table, hours(spark, "2024-01-01 11")).count() == 2


def test_incremental_load(spark, tmp_path):
    path = str(tmp_path / "loaded")
    source = social(spark, ["2024-01-01 00", "2024-01-01 01"])
    sinks.write_hours(source.where("dh = '2024-01-01 00'"), path)
    for _ in range(2):
        loaded = readers.read_hourly(spark, path, HOURLY_TABLES["agg_social"])
        sinks.write_hours(backfill.incremental_rows(source, loaded), path)
    assert readers.read_hourly(spark, path, HOURLY_TABLES["agg_social"]).count() == 2


def test_hour_planning_prunes_every_log(spark, tmp_path):
    names = ("imps", "bids", "clicks", "done")
    for name in names:
        spark.range(48).selectExpr("id AS auction_id_64", "format_string('2024-01-0%d %02d', 1 + CAST(id / 24 AS INT), id % 24) AS dh") \
            .write.partitionBy("dh").parquet(str(tmp_path / name))
    logs = [spark.read.schema("auction_id_64 bigint, dh string").parquet(str(tmp_path / n)) for n in names]
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(backfill.ready_hours(*logs, "2024-01-09 12"))
    scans = re.findall(r"FileScan parquet .*", plan)
    assert len(scans) == 4 and all("> 2024-01-01 12)" in s.split("PartitionFilters: ")[1].split("PushedFilters")[0] for s in scans)
    assert not re.search("Join", plan)
    assert "PartitionFilters: [isnotnull(dh" in text(backfill.retained_hours(logs[0], "2024-01-09 12", 8))
    loaded = logs[3].where("dh <> '2024-01-02 05'")
    load = backfill.incremental_rows(logs[0], loaded)
    assert "PartitionFilters: [isnotnull(dh" in text(load) and "Join" not in text(load)
    assert [r["auction_id_64"] for r in load.collect()] == [29]
