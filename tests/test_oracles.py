"""Every query against its SQL, on the smallest tables (those with late clicks on the next size)."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from auctionlens.plans.oracles import all_oracles
from auctionlens.plans.queries import all_queries

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
# Auctions with several clicks and non-empty campaign lists only exist from this size on.
LARGER = {
    "agg_display_os", "agg_conversions_campaign", "agg_campaign_clicks", "big_cpa_campaigns", "node_metrics",
    "agg_four_way",
}


@pytest.fixture(scope="module")
def databases():
    out = {}
    for size in ("sf0.001", "sf0.01"):
        db = duckdb.connect()
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{size}/{t}.parquet'")
        out[size] = db
    return out


def canonical(records):
    return sorted(records, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, databases, name):
    size = "sf0.01" if name in LARGER else "sf0.001"
    df = all_queries()[name](spark, f"{ROOT}/{size}")
    columns = sorted(df.columns)
    got = canonical(tuple(r[c] for c in columns) for r in df.collect())
    want = databases[size].sql(all_oracles()[name])
    types = dict(zip(want.columns, map(str, want.types)))
    assert sorted(want.columns) == columns
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == types
    order = [want.columns.index(c) for c in columns]
    assert got == canonical(tuple(r[i] for i in order) for r in want.fetchall())
    assert got or size == "sf0.001"


def test_all_queries_have_sql():
    assert set(all_queries()) == set(all_oracles())


def test_entry(spark):
    assert driver.entry(spark).columns[-2:] == ["imps", "clicks"]
