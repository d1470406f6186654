"""Buckets, impurity and goal checks against plain-Python versions of their definitions."""

import math
import random
from collections import defaultdict

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auctionlens.functions.measures import split_entropy
from auctionlens.operators import buckets, confusion, impurity

FEATURES = ["a", "b", "c"]
SCHEMA = "a string, b string, c string, campaign_id int, imps bigint, clicks bigint"


def data(seed, n=300, hot=True):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = ("x", "x", "x") if hot and rng.random() < 1 / 3 else tuple(rng.choice("xyzw") for _ in range(3))
        imps = rng.randrange(1, 30)
        out.append((*key, rng.randrange(3), imps, rng.randrange(imps + 1)))
    return out + [(None, "x", "x", 1, 100, 1)]


def grouped(records, start):
    sums = defaultdict(lambda: [0, 0])
    for key, imps, clicks in records:
        cell = sums[key[start:]]
        cell[0] += imps
        cell[1] += clicks
    return sums


def levels(records, floor):
    """Bucket keys per level, and the remainder."""
    left = [(r[:3], r[4], r[5]) for r in records if None not in r[:3]]
    out = []
    for k in range(3):
        sums = grouped([((None,) * k + key[k:] if len(key) == 3 else key, i, c) for key, i, c in left], k)
        out += [(k, *([None] * k), *key, i, c) for key, (i, c) in sums.items() if i >= floor]
        left = [((None,) * k + key, i, c) for key, (i, c) in sums.items() if i < floor]
    rest = (3, None, None, None, sum(i for _, i, _ in left) + 1, sum(c for _, _, c in left))
    return out + [rest]


@pytest.mark.parametrize("seed,floor", [(1, 1), (2, 80), (3, 200), (4, 10**6)])
def test_bucketize_equals_brute_force(spark, seed, floor):
    records = data(seed)
    df = spark.createDataFrame(records, SCHEMA)
    got = buckets.bucketize(df, FEATURES, floor)
    want = sorted(levels(records, floor), key=lambda t: [(x is not None, str(type(x)), x) for x in t])
    assert rows(got) == want
    assert sum(r["imps"] for r in got.collect()) == sum(r[4] for r in records if r[0]) + 1


def test_bucketize_of_nothing_is_the_remainder(spark):
    assert rows(buckets.bucketize(spark.createDataFrame([], SCHEMA), FEATURES, 5)) == [(3, None, None, None, 1, 0)]


def place(record, built):
    for k in range(3):
        if any(b[0] == k and b[1 + k : 4] == record[k:3] for b in built):
            return k
    return 3


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_applying_buckets(spark, conf, broadcast):
    conf(spark__sql__autoBroadcastJoinThreshold=broadcast)
    base, other = data(1), data(9)
    built = levels(base, 90)
    stored = buckets.bucketize(spark.createDataFrame(base, SCHEMA), FEATURES, 90)
    sums, per_campaign = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for r in other:
        if None in r[:3]:
            continue
        k = place(r, built)
        key = (k, *([None] * k), *r[k:3])
        for cells, cell_key in ((sums, key), (per_campaign, (*key, r[3]))):
            cells[cell_key][0] += r[4]
            cells[cell_key][1] += r[5]
    df = spark.createDataFrame(other, SCHEMA)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in buckets.bucket_perf(df, stored, FEATURES).collect()}
    assert got == {k: tuple(v) for k, v in sums.items() if k[0] < 3}
    got = {tuple(r)[:5]: tuple(r)[5:] for r in buckets.bucket_perf_campaign(df, stored, FEATURES).collect()}
    assert got == {k: tuple(v) for k, v in per_campaign.items()}


def test_levels_are_found_for_keys_not_for_campaigns(spark, monkeypatch):
    """Only the different keys are offered at every level; the sums of campaigns meet the level of their key."""
    offered, match = [], buckets.match_buckets
    monkeypatch.setattr(buckets, "match_buckets", lambda df, *rest: offered.append(df) or match(df, *rest))
    df = spark.createDataFrame(data(6), SCHEMA)
    buckets.bucket_perf_campaign(df, buckets.bucketize(df, FEATURES, 90), FEATURES)
    assert [x.columns for x in offered] == [FEATURES]
    assert rows(offered[0]) == sorted({r[:3] for r in data(6) if r[0]})


def test_bucket_update(spark):
    base = [("x", "x", "x", 1, 100, 1), ("y", "x", "x", 1, 100, 1), ("z", "y", "y", 1, 10, 1), ("w", "y", "y", 1, 95, 1)]
    stored = buckets.bucketize(spark.createDataFrame(base, SCHEMA), FEATURES, 90)
    new = [
        ("x", "x", "x", 1, 20, 0), ("y", "x", "x", 1, 200, 0), ("q", "x", "x", 1, 300, 0),
        ("z", "y", "y", 1, 30, 0), ("p", "y", "y", 1, 240, 0),
    ]
    got = buckets.bucket_update(spark.createDataFrame(new, SCHEMA), stored, FEATURES, 50, 250)
    assert rows(got) == [
        (0, "q", "x", "x", 300, 0, "grow"), (0, "x", "x", "x", 20, 0, "delete"), (1, None, "y", "y", 270, 0, "grow"),
    ]


def entropy(n, y):
    return 0 if y in (0, n) else -((n - y) * math.log((n - y) / n) + y * math.log(y / n))


def test_summary_and_gain(spark):
    records = data(4)
    built = levels(records, 90)
    row = buckets.bucket_summary(buckets.bucketize(spark.createDataFrame(records, SCHEMA), FEATURES, 90)).first()
    imps, clicks = sum(b[4] for b in built), sum(b[5] for b in built)
    total = sum(int(sum(entropy(b[4], b[5]) for b in built if b[0] == k)) for k in range(4))
    assert row["num_buckets"] == len(built) and (row["imps"], row["clicks"]) == (imps, clicks)
    assert row["info_gain"] == pytest.approx(1 - total / entropy(imps, clicks))
    assert row["total_var"] == pytest.approx(-sum(b[5] ** 2 / b[4] for b in built))
    gain = buckets.campaign_gain(
        buckets.bucket_perf_campaign(
            spark.createDataFrame(records, SCHEMA),
            buckets.bucketize(spark.createDataFrame(records, SCHEMA), FEATURES, 90), FEATURES,
        ), 1000.0,
    ).first()
    assert gain["info_gain"] == pytest.approx(1 - gain["conditional_entropy"] / 1000.0)


def test_entropy_edges(spark):
    df = spark.createDataFrame([(5, 0), (5, 5), (5, 2)], "n int, y int")
    got = [r[0] for r in df.select(split_entropy(F.col("n"), F.col("y"))).collect()]
    assert got == pytest.approx([0, 0, entropy(5, 2)])


def test_contingency_and_histogram(spark):
    df = spark.createDataFrame(data(2), SCHEMA)
    table = buckets.contingency(df, "a", F.col("clicks") > 5).collect()
    assert {r["a"] for r in table} == set("xyzw")
    assert sum(r["weight_true"] + r["weight_false"] for r in table) == sum(r[4] for r in data(2) if r[0])
    bins = buckets.key_report_histogram(df, ["a", "b"]).collect()
    assert len(bins) == 60
    for metric in ("log_ctr", "log_imps"):
        assert sum(r["percent"] for r in bins if r["metric"] == metric) == pytest.approx(100)
    same = spark.createDataFrame([("x", "x", "x", 1, 10, 1), ("y", "x", "x", 1, 10, 1)], SCHEMA)
    flat = [r for r in buckets.key_report_histogram(same, ["a"]).collect() if r["percent"]]
    assert {(r["metric"], r["bin"]) for r in flat} == {("log_ctr", 15), ("log_imps", 15)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("uvw"), st.integers(1, 50)), min_size=1, max_size=20))
def test_impurity_properties(spark, records):
    df = spark.createDataFrame(records, "a string, b string, imps int")
    own = impurity.gini(df, "b").first()["gini"]
    given_a = impurity.gini_weighted(df, "a", "b").first()["gini"]
    assert -1e-9 <= given_a <= own + 1e-9 and own < 1
    cells = {(r["given"], r["feature"]): r["impurity"] for r in impurity.impurity_matrix(df, ["a", "b"]).collect()}
    assert cells[("", "b")] == pytest.approx(own, abs=6e-4)
    assert cells[("a", "b")] == pytest.approx(given_a, abs=6e-4)
    assert cells[("a", "a")] == 0 and len(cells) == 6


NODES = (
    "campaign_group_id int, country_group_id int, tag_id int, creative_size_bucket_id int, pixel_id int, ymdh string, "
    "qt_start_time_adjusted string, qt_finish_time string, is_passed int, imps bigint, clicks bigint, "
    "post_view_convs bigint, post_click_convs bigint, booked_rev double"
)


def node(cg, tag, ymdh, passed, imps=0, clicks=0, pv=0, pc=0, spent=0.0, pixel=1):
    return (cg, 1, tag, 1, pixel, ymdh, "2024-01-01 05", "2024-01-01 10", passed, imps, clicks, pv, pc, spent)


def cells(df):
    return {(r["matrix"], r["row"], r["col"]): r["n"] for r in df.collect()}


def test_confusion_cpa(spark):
    goals = spark.createDataFrame(
        [(1, 5, 10.0, None), (1, 4, 999.0, 999.0), (2, 6, 10.0, 10.0)],
        "cg_id int, pixel_id int, pvg_threshold double, pcg_threshold double",
    )
    merged = spark.createDataFrame(
        [
            # The decision of the earliest hour counts; the view lies in the test.
            node(1, 1, "2024-01-01 06", 0, pv=1, spent=5.0), node(1, 1, "2024-01-01 04", 1),
            # The click conversion has no goal, and the view comes too late.
            node(1, 2, "2024-01-01 11", 0, pv=1, pc=5, spent=20.0),
            # Only the sum of both kinds exceeds the spend.
            node(2, 1, "2024-01-01 10", 1, pv=1, pc=1, spent=15.0),
            # No goal row at all.
            node(3, 1, "2024-01-01 06", 1, pv=1),
            node(None, 1, "2024-01-01 06", 1, pv=1),
        ],
        NODES,
    )
    summed, either = (cells(confusion.confusion_cpa(merged, goals, s)) for s in (True, False))
    assert summed == {
        ("definition", 0, 0): 2, ("definition", 0, 1): 0, ("definition", 1, 0): 0, ("definition", 1, 1): 1,
        ("performance", 0, 0): 2, ("performance", 0, 1): 0, ("performance", 1, 0): 0, ("performance", 1, 1): 1,
    }
    assert either[("performance", 0, 0)] == 1 and either[("performance", 1, 0)] == 1
    perf = cells(confusion.confusion_perf_cpa(merged, goals))
    assert perf == {
        ("performance", 0, 0): 2, ("performance", 0, 1): 0, ("performance", 1, 0): 0, ("performance", 1, 1): 1,
    }
    assert sum(cells(confusion.confusion_def_cpa(merged, goals)).values()) == 3
    grid = confusion.as_grid(confusion.confusion_def_cpa(merged, goals))
    assert rows(grid) == [("definition", 0, 2, 0), ("definition", 1, 0, 1)]


def test_first_decision_of_odd_values(spark):
    hours = [(1, "2024-01-01 05", 2), (1, "2024-01-01 06", 1), (2, "2024-01-01 05", None), (2, "2024-01-01 06", 1),
             (3, "2024-01-01 05", 1), (3, "2023-12-31 23", 1), (3, "2024-01-01 04", 0), (4, None, 1),
             (5, "2024-01-01 05", 1), (5, "2024-01-01 05", 0), (6, "2024-01-01 05", -1)]
    df = spark.createDataFrame(hours, "node int, ymdh string, is_passed int")
    got = dict(df.groupBy("node").agg(confusion._first_decision()).collect())
    assert got == {1: 0, 2: None, 3: 1, 4: None, 5: 0, 6: 0}


def test_confusion_ctr(spark):
    goals = spark.createDataFrame([(1, 0.1)], "cg_id int, goal_threshold double")
    merged = spark.createDataFrame(
        [
            node(1, 1, "2024-01-01 05", 1, imps=10, clicks=2), node(1, 2, "2024-01-01 04", 1, imps=10, clicks=2),
            node(1, 3, "2024-01-01 06", 0, imps=100, clicks=10, pixel=2),
        ],
        NODES,
    )
    got = cells(confusion.confusion_ctr(merged, goals))
    assert [got[("definition", r, c)] for r in (0, 1) for c in (0, 1)] == [1, 1, 1, 0]
    assert [got[("performance", r, c)] for r in (0, 1) for c in (0, 1)] == [1, 1, 1, 0]
    perf = cells(confusion.confusion_perf_ctr(merged, goals))
    assert [perf[("performance", r, c)] for r in (0, 1) for c in (0, 1)] == [2, 0, 0, 1]
    assert sum(cells(confusion.confusion_def_ctr(merged, goals)).values()) == 3
