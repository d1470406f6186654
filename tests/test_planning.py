"""Hours planned from partition names and journals."""

import re

import pytest
from conftest import rows

from auctionlens.operators import backfill
from auctionlens.plans import jobs
from auctionlens.schemas import BIDS, CLICKS, CONVERSIONS, HOURLY_TABLES, IMPS, create_table
from auctionlens.sources import readers, sinks
from auctionlens.sources.catalog import Catalog, HourFolder, Table
from auctionlens.sources.fixtures import fixture_catalog
from auctionlens.sources.ledger import HourLedger
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DAY = [f"2024-01-01 {h:02d}" for h in range(8)]


def with_day(schema):
    return StructType([*schema, StructField("dd", StringType())])


@pytest.fixture
def logs(spark):
    """Catalog tables of a few hours: one hour has no bids, one has an empty partition of clicks."""
    for name, schema in (("p_imps", IMPS), ("p_bids", BIDS), ("p_clicks", CLICKS), ("p_done", HOURLY_TABLES["agg_auction_features"])):
        if name != "p_done":
            schema = StructType([*[f for f in schema if f.name != "dh"], StructField("dd", StringType()), StructField("dh", StringType())])
        create_table(spark, name, schema)
    fill = lambda name, hours, **values: spark.createDataFrame([(h,) for h in hours], "dh string").select(
        *[(F.lit(values.get(f.name)).cast(f.dataType) if f.name not in ("dd", "dh") else F.col("dh").substr(1, 10 if f.name == "dd" else 13)).alias(f.name)
          for f in spark.table(name).schema]
    ).write.insertInto(name)
    fill("p_imps", DAY, auction_id_64=1, seller_member_id=7, buyer_member_id=9, content_category_id=1)
    fill("p_bids", [h for h in DAY if h != DAY[3]], auction_id_64=1, payment_type=0, campaign_id=2)
    fill("p_clicks", [h for h in DAY if h != DAY[5]], auction_id_64=1)
    spark.sql(f"ALTER TABLE p_clicks ADD PARTITION (dd = '2024-01-01', dh = '{DAY[5]}')")
    fill("p_done", DAY[:2], imps=1)
    yield ["p_imps", "p_bids", "p_clicks", "p_done"]
    for name in ("p_imps", "p_bids", "p_clicks", "p_done"):
        spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planning_reads_names_only(spark, logs):
    names = [readers.partition_hours(spark, t) for t in logs]
    ready = backfill.ready_hours(*names, "2024-01-02 00")
    retained = backfill.retained_hours(names[0], "2024-01-09 04", 8)
    load = backfill.hours_to_load(names[0], names[3])
    for df in (ready, retained, load):
        assert "FileScan" not in plan(df)
    # By name the hour with the empty partition of clicks is ready; a look into the few planned hours leaves it out.
    assert rows(ready.select("dh")) == [(DAY[i],) for i in (2, 4, 5, 6)]
    assert rows(retained) == [(h,) for h in DAY[4:]] and rows(load) == [(h,) for h in DAY[2:]]
    found = backfill.populated(ready, [spark.table(t) for t in logs[:3]])
    assert rows(found.select("dh")) == [(DAY[i],) for i in (2, 4, 6)]
    scans = re.findall(r"FileScan parquet .*", plan(found))
    assert scans and all(re.search(r"PartitionFilters: \[[^]]*2024-01-01 0[456]", s) for s in scans)


def test_run_over_catalog_tables(spark, logs, tmp_path):
    tables = Catalog(spark, {"imps": Table("p_imps"), "bids": Table("p_bids"), "clicks": Table("p_clicks"), "aggregated_hours": Table("p_done")})
    assert jobs.aggregate_ready_hours(tables, "2024-01-02 00", str(tmp_path / "out")) == [DAY[i] for i in (2, 4, 6)]
    out = HourFolder(str(tmp_path / "out"), HOURLY_TABLES["agg_auction_features"])
    done = Catalog(spark, {"imps": Table("p_imps"), "bids": Table("p_bids"), "clicks": Table("p_clicks"), "aggregated_hours": out})
    assert rows(done.hours("aggregated_hours")) == [(DAY[i],) for i in (2, 4, 6)]
    assert jobs.aggregate_ready_hours(done, "2024-01-02 00", str(tmp_path / "out")) == DAY[:2]


def test_listed_hours(spark, tmp_path):
    path = str(tmp_path / "a+b c")
    clicks = spark.createDataFrame([(1, h) for h in DAY[:3]], CLICKS)
    sinks.write_hours(clicks, path, deep=True)
    (tmp_path / "a+b c" / "dy=2024" / "dm=2024-01" / "dd=2024-01-01" / "dh=2024-01-01 23").mkdir()
    listed = readers.listed_hours(spark, path)
    assert rows(listed) == [(h,) for h in DAY[:3]] and "parquet" not in plan(listed).replace("*.parquet", "").lower()
    assert rows(Catalog(spark, {"c": HourFolder(path, CLICKS), "d": clicks}).hours("c")) == rows(listed)
    assert rows(Catalog(spark, {"d": clicks}).hours("d")) == rows(listed)


class Dies(HourLedger):
    def commit(self, counts, batch=-1):
        raise RuntimeError("lost")


def test_load_is_journaled(spark, tmp_path):
    tables = fixture_catalog(spark, "/root/testdata/sf0.001")
    source = tables["conversions"]
    early = Catalog(spark, {"conversions": source.where("dh < '2024-01-01 12'")})
    out, book = str(tmp_path / "convs"), str(tmp_path / "book")
    stored = lambda: spark.read.schema(CONVERSIONS).parquet(out).select(source.columns)
    # The run dies between the write and the journal: its hours are still missing and are loaded again, once.
    with pytest.raises(RuntimeError):
        jobs.load_missing_hours(early, "conversions", Dies(spark, book), out)
    ledger = HourLedger(spark, book)
    assert ledger.entries().count() == 0 and stored().count() == early["conversions"].count()
    first = jobs.load_missing_hours(early, "conversions", ledger, out)
    assert first == sorted(r.dh for r in early.hours("conversions").collect()) and rows(stored()) == rows(early["conversions"])
    rest = jobs.load_missing_hours(tables, "conversions", ledger, out)
    assert rest and not set(rest) & set(first) and rows(stored()) == rows(source)
    assert jobs.load_missing_hours(tables, "conversions", ledger, out) == []
    assert ledger.entries().agg(F.sum("n_rows")).first()[0] == source.count() and not ledger.differing(stored()).count()


def test_journal_tells_changed_hours(spark, tmp_path):
    ledger = HourLedger(spark, str(tmp_path / "book"))
    hours = lambda *h: spark.createDataFrame([(1, x) for x in h], CLICKS)
    assert rows(ledger.missing(hours(*DAY[:2]).select("dh"))) == [(h,) for h in DAY[:2]]
    ledger.commit(hours(*DAY[:2], DAY[0]).groupBy("dh").agg(F.count("*").alias("n_rows")))
    ledger.commit(hours(DAY[1]).groupBy("dh").agg(F.count("*").alias("n_rows")))
    assert rows(ledger.entries().select("dh", "n_rows")) == [(DAY[0], 2), (DAY[1], 1)]
    assert rows(ledger.missing(hours(*DAY[:3]).select("dh"))) == [(DAY[2],)]
    assert rows(ledger.differing(hours(DAY[0], DAY[1], DAY[2]))) == [(DAY[0], 2, 1), (DAY[2], 0, 1)]
