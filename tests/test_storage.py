"""Storage that saves work later: bucketed impressions, ordered reports, the keyword index."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auctionlens.operators import clog, hourly, reporting, tweets
from auctionlens.plans import jobs
from auctionlens.plans.queries import all_queries
from auctionlens.schemas import BIDS, IMPS, TREE_CAMPAIGN_IMPS, create_table
from auctionlens.sources import sinks
from auctionlens.sources.fixtures import fixture_catalog

ROOT = "/root/testdata/sf0.001"


def stored_schema(schema):
    last = [StructField("dd", StringType()), StructField("dh", StringType())]
    return StructType([*[f for f in schema if f.name != "dh"], *last])


@pytest.fixture(scope="module")
def tables(spark):
    return fixture_catalog(spark, ROOT)


@pytest.fixture(scope="module")
def buckets(spark, tables):
    for name, schema in (("b_imps", IMPS), ("b_bids", BIDS)):
        create_table(spark, name, stored_schema(schema), bucket_by="auction_id_64", buckets=6)
        for _ in range(2):  # a repeated write replaces its hours
            sinks.write_bucketed_hours(tables[name[2:]], name, "auction_id_64", 6)
    yield spark.table("b_imps"), spark.table("b_bids")
    for name in ("b_imps", "b_bids"):
        spark.sql(f"DROP TABLE {name}")


def above(plan, scan):
    """Names of the operators between the scan of a table and the first join over it, from the printed plan."""
    lines = [(re.search(r"[A-Za-z*]", x).start(), x) for x in plan.splitlines() if re.search(r"[A-Za-z]", x)]
    at = next(i for i, (_, x) in enumerate(lines) if "FileScan" in x and scan in x)
    depth, out = lines[at][0], []
    for place, line in reversed(lines[:at]):
        if place < depth:
            depth = place
            if "Join" in line:
                break
            out.append(line.strip(" +-:*()0123456789"))
    return out


def test_bucketed_tables_hold_the_log(buckets, tables):
    assert rows(buckets[0].select(tables["imps"].columns)) == rows(tables["imps"])
    assert rows(buckets[1].select(tables["bids"].columns)) == rows(tables["bids"])


@pytest.mark.parametrize("name", [*hourly.JOBS, "four_way"])
def test_impressions_in_buckets_are_not_shuffled(spark, conf, buckets, tables, name):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    imps, bids = buckets
    if name == "four_way":
        build = lambda i, b, **c: hourly.four_way_aggregate(i, b, tables["clicks"], **c)
    else:
        job = hourly.JOBS[name]
        chosen = spark.range(50).select(F.col("id").cast("int").alias("campaign_id")) if job.chosen_campaigns else None
        build = lambda i, b, **c: hourly.hourly_aggregate(name, i, b, tables[job.response], chosen, **c)
    got = build(imps, bids, colocated=True)
    path = above(got._jdf.queryExecution().executedPlan().toString(), "b_imps")
    assert path and not any("Exchange" in x for x in path), path
    # The log as it comes is shuffled once, for the join.
    plain = above(build(imps, bids)._jdf.queryExecution().executedPlan().toString(), "b_imps")
    assert sum("Exchange" in x for x in plain) == 1
    if name in ("agg_display_os", "agg_auction_features", "agg_conversions_campaign", "four_way"):
        assert rows(got) == rows(build(tables["imps"], tables["bids"]))


def test_bids_in_buckets_are_not_shuffled_either(conf, buckets, tables):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    got = hourly.hourly_aggregate("agg_display_os", *buckets, tables["clicks"], colocated=True)
    path = above(got._jdf.queryExecution().executedPlan().toString(), "b_bids")
    assert not any("Exchange" in x for x in path), path


def test_tree_campaign_rows_have_the_stored_schema(spark, tables, tmp_path):
    path = str(tmp_path / "tree")
    jobs.write_tree_campaign_imps(tables, "2024-01-01 05", "2024-01-01 23", path)
    found = {f.name: f.dataType for f in spark.read.parquet(path).schema if f.name not in ("dy", "dm", "dd", "dh")}
    assert found == {f.name: f.dataType for f in TREE_CAMPAIGN_IMPS if f.name not in ("dy", "dm", "dd", "dh")}
    create_table(spark, "tree_imps", TREE_CAMPAIGN_IMPS, ("dy", "dm", "dd", "dh"))
    spark.read.schema(TREE_CAMPAIGN_IMPS).parquet(path).write.insertInto("tree_imps")
    assert spark.table("tree_imps").count() == spark.read.parquet(path).count() > 0
    spark.sql("DROP TABLE tree_imps")


@pytest.mark.parametrize("name", ["learn_share", "clogged_nodes"])
def test_reports_are_ordered_after_a_write(spark, conf, tmp_path, name):
    conf(spark__sql__shuffle__partitions="5", spark__sql__adaptive__coalescePartitions__enabled="false")
    report = all_queries()[name](spark, ROOT)
    path = str(tmp_path / name)
    if name == "learn_share":
        order, key = reporting.learn_share_order(), lambda r: (r.ymd, -r.imps)
    else:
        order, key = clog.clog_order(), lambda r: (-r.clogged_offers, *(getattr(r, k) for k in clog.SELL_SIDE))
    sinks.write_report(report, path, *order)
    got = sinks.read_report(spark, path).collect()
    assert len(got) > 10 and [key(r) for r in got] == sorted(key(r) for r in got)
    assert rows(report) == rows(sinks.read_report(spark, path).select(report.columns))
    # Files hold adjoining ranges, each in order.
    files = sorted((tmp_path / name).glob("part-*.parquet"))
    each = [[key(r) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert len(files) > 1 and all(x == sorted(x) for x in each)
    each = [x for x in each if x]
    assert all(a[-1] <= b[0] for a, b in zip(each, each[1:]))


TWEETS = "tweet_id bigint, text string"


def test_many_keywords_are_a_join(spark, conf):
    texts = ["Hello World", "say helloworld", None, "", "a b", "ÄRGER und Lärm", "x  y", "hel", "the end.", "100%_sure"]
    many = spark.createDataFrame(list(enumerate(texts)), TWEETS)
    words = ["hello", " WORLD ", "ärg", "b", "  ", "", "o w", "x  y", "l_", "%_s", "zzz"]
    for some in (words, words[:1], words[4:6], ["hello"] * 3, [f"k{i}q" for i in range(10_000)] + ["end."]):
        keywords = spark.createDataFrame([(w,) for w in some] + [(None,)], "keyword string")
        got = rows(tweets.tweet_track_many(many, keywords).select("tweet_id"))
        text = [(i, t.lower()) for i, t in enumerate(texts) if t is not None]
        assert got == [(i,) for i, t in text if any(w.strip() and w.strip().lower() in t for w in some)]
    # The plan does not grow with the list.
    def size(n):
        keywords = spark.createDataFrame([(f"k{i}q",) for i in range(n)], "keyword string")
        plan = tweets.tweet_track_many(many, keywords)._jdf.queryExecution().executedPlan().toString()
        return len(plan.splitlines()), re.findall("CartesianProduct|NestedLoop", plan)

    assert size(5) == size(10_000) and size(5)[1] == []
