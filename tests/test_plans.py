"""Plan shapes that have to hold whatever the data size."""

import re

import pytest

import __spark_entry__ as driver
from auctionlens.plans.queries import all_queries

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_products_and_no_single_task_windows(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    for name, query in all_queries().items():
        text = plan(query(spark, DIR))
        assert not re.search(r"CartesianProduct|NestedLoopJoin|Window", text), name


def test_impression_log_is_scanned_once(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    for name in ("agg_display_os", "agg_four_way", "agg_conversions_seller"):
        text = plan(driver.queries()[name](spark, DIR))
        scans = re.findall(r"FileScan parquet \[(.*?)\].*lineitem", text)
        assert len(scans) == 1, name
        assert "l_extendedprice" not in scans[0] and "l_tax" not in scans[0]


@pytest.mark.parametrize("name", ["perf_data_daily", "learn_share", "ctr_node_rows"])
def test_short_lists_filter_before_the_aggregation(spark, name):
    text = plan(driver.queries()[name](spark, DIR))
    assert text.index("LeftSemi") > text.index("partial_sum")


def test_hash_aggregation_over_the_fact(spark):
    for name in ("site_daily_stats", "confusion_cpa_v1", "bucketize", "key_report"):
        text = plan(driver.queries()[name](spark, DIR))
        fact = text[: text.index("lineitem")].rsplit("Exchange", 1)[1]
        assert "HashAggregate" in fact and "SortAggregate" not in fact, name
