"""Hourly aggregates on streams: the rows of the batch jobs, late rows, restarts."""

from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from auctionlens.operators import hourly
from auctionlens.plans import stored as plans_stored
from auctionlens.schemas import BIDS, CLICKS, CONVERSIONS, IMPS
from auctionlens.sources.catalog import Catalog
from auctionlens.sources.fixtures import fixture_catalog
from auctionlens.sources.ledger import HourLedger, committed
from auctionlens.streaming import hourly as stream

SCHEMAS = {"imps": IMPS, "bids": BIDS, "clicks": CLICKS, "conversions": CONVERSIONS}
#: Far enough behind everything to let the watermark pass.
END = "2024-01-06 00"


@pytest.fixture
def few(conf):
    conf(spark__sql__shuffle__partitions="2", spark__sql__session__timeZone="America/New_York")


class Logs:
    """Folders of arriving files."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, **logs):
        for name, df in logs.items():
            df.select(SCHEMAS[name].names).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def end(self, *names):
        """A row of a later hour in every log; it passes all filters, which Spark moves below the watermark."""
        last = {"imps": imp(-1, END), "bids": (-1, END, 0, 8), "clicks": (-1, END), "conversions": (-1, END, 1)}
        self.add(**{n: table(self.spark, SCHEMAS[n], last[n]) for n in names})

    def streams(self, *names, **options):
        return [stream.stream_log(self.spark, f"{self.folder}/{n}", SCHEMAS[n], **options) for n in names]


def run(result, folder):
    query = stream.start_hours(result, f"{folder}/out", f"{folder}/ledger", f"{folder}/check", once=True)
    query.awaitTermination()


def stored(spark, folder, columns):
    whole = spark.read.schema(f"{columns}, dd string, dh string, batch bigint").parquet(f"{folder}/out")
    return committed(whole, HourLedger(spark, f"{folder}/ledger"))


def table(spark, kind, *values):
    return spark.createDataFrame(list(values), kind)


def imp(auction, hour, domain="a.example"):
    return (auction, hour, "1", 0, 0, 1, 300, 250, 1, domain, "app", "US", 7, 9, 5)


def columns_of(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "dh")


@pytest.mark.parametrize("name, responses", [("agg_display_os", "clicks"), ("agg_conversions_seller", "conversions")])
def test_replayed_day_is_the_batch_job(spark, few, tmp_path, name, responses):
    tables = fixture_catalog(spark, "/root/testdata/sf0.001")
    logs = Logs(spark, tmp_path)
    for n in ("imps", "bids", responses):
        # Two deliveries, the second with the earlier hours.
        for half in ("dh >= '2024-01-01 12'", "dh < '2024-01-01 12'"):
            logs.add(**{n: tables[n].where(half)})
    logs.end("imps", "bids", responses)
    want = hourly.hourly_aggregate(name, tables["imps"], tables["bids"], tables[responses])
    result = stream.streamed_aggregate(name, *logs.streams("imps", "bids", responses), delay="1 day")
    assert result.isStreaming and result.schema.simpleString() == want.schema.simpleString()
    run(result, tmp_path)
    got = stored(spark, tmp_path, columns_of(want))
    assert rows(got.select(want.columns)) == rows(want)
    assert not HourLedger(spark, f"{tmp_path}/ledger").differing(got).count()


def test_click_windows_and_late_rows(spark, few, tmp_path):
    hour = "2024-01-01 %02d"
    logs = Logs(spark, tmp_path)
    bids = [(i, hour % 5, 0, 1) for i in (1, 2, 3, 4)] + [(1, hour % 5, 3, 1), (2, hour % 5, 1, 1)]
    logs.add(
        imps=table(spark, IMPS, *[imp(i, hour % 5) for i in (1, 2, 3, 4)], imp(9, hour % 5)),
        bids=table(spark, BIDS, *bids),
        # Out of order: the click of the next hour comes before that of the hour itself; the third is out of the window.
        clicks=table(spark, CLICKS, (1, hour % 6), (1, hour % 5), (2, hour % 7), (3, hour % 4)),
    )
    logs.end("imps", "bids", "clicks")
    result = stream.streamed_aggregate("agg_display_os", *logs.streams("imps", "bids", "clicks"))
    run(result, tmp_path)
    want = hourly.hourly_aggregate(
        "agg_display_os", table(spark, IMPS, *[imp(i, hour % 5) for i in (1, 2, 3, 4)]), table(spark, BIDS, *bids),
        table(spark, CLICKS, (1, hour % 6), (1, hour % 5)),
    )
    got = stored(spark, tmp_path, columns_of(want)).select(want.columns)
    assert rows(got) == rows(want) and [(r.imps, r.clicks) for r in got.collect()] == [(5, 2)]
    # A click for an hour that has been given out: it is dropped, and nothing is written twice.
    logs.add(clicks=table(spark, CLICKS, (4, hour % 5)), imps=table(spark, IMPS, imp(4, hour % 5)))
    again = stream.streamed_aggregate("agg_display_os", *logs.streams("imps", "bids", "clicks"))
    run(again, tmp_path)
    assert rows(stored(spark, tmp_path, columns_of(want)).select(want.columns)) == rows(want)


def repeated():
    """An auction with 40 impressions, 30 bids and 3 conversions, and rows without an auction or an hour."""
    hour = "2024-01-01 05"
    imps = [imp(1, hour, f"{i % 2}.example") for i in range(40)] + [imp(None, hour), imp(2, None), imp(3, hour)]
    bids = [(1, hour, 0, 8)] * 30 + [(None, hour, 0, 8), (2, None, 0, 8), (4, hour, 0, 8)]
    return {"imps": imps, "bids": bids, "conversions": [(1, hour, 1)] * 2 + [(1, "2024-01-02 04", 1), (1, "2024-01-02 05", 1), (None, hour, 1)]}


def test_state_is_a_row_per_auction_and_hour(spark, few, tmp_path):
    tables = {n: table(spark, SCHEMAS[n], *values) for n, values in repeated().items()}
    logs = Logs(spark, tmp_path)
    logs.add(**tables)
    logs.end(*tables)
    result = stream.streamed_aggregate("agg_conversions_seller", *logs.streams(*tables))
    query = stream.start_hours(result, f"{tmp_path}/out", f"{tmp_path}/ledger", f"{tmp_path}/check", once=True)
    query.awaitTermination()
    want = hourly.hourly_aggregate("agg_conversions_seller", *tables.values())
    got = stored(spark, tmp_path, columns_of(want)).select(want.columns)
    assert rows(got) == rows(want) and [(r.imps, r.pc_convs) for r in got.collect()] == [(1800, 1800)] * 2
    # Auctions 1, 3, 4 and the closing one; what is complete and its responses; the two groups.
    assert sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) <= 20


def test_hours_arriving_one_by_one(spark, few, tmp_path):
    """A batch for each hour, then one a day later: responses find auctions of earlier batches."""
    hours = ["2024-01-01 05", "2024-01-01 06", "2024-01-01 07", "2024-01-03 07", "2024-01-03 08"]
    logs, every = Logs(spark, tmp_path), {"imps": [], "bids": [], "clicks": []}
    for n, hour in enumerate(hours):
        part = {
            "imps": [imp(10 * n + i, hour, f"{i}.example") for i in range(4)] * 2,
            "bids": [(10 * n + i, hour, 0, 8) for i in range(3)] + [(10 * n, hour, 0, 9)],
            # Of the hour itself, of the one before, and of two before, which is out of the window.
            "clicks": [(10 * (n - back) + back, hour) for back in (0, 1, 2)] * 3 + [(10 * n + 3, hour)],
        }
        logs.add(**{name: table(spark, SCHEMAS[name], *values) for name, values in part.items()})
        every = {name: every[name] + part[name] for name in every}
    logs.end(*every)
    result = stream.streamed_aggregate("agg_display_rtb", *logs.streams(*every, files_per_batch=1))
    run(result, tmp_path)
    want = hourly.hourly_aggregate("agg_display_rtb", *[table(spark, SCHEMAS[name], *values) for name, values in every.items()])
    got = stored(spark, tmp_path, columns_of(want)).select(want.columns)
    assert rows(got) == rows(want) and got.where("clicks > 0").count() == 8


def test_state_of_a_stored_day_is_on_disk(spark, few):
    tables = {n: table(spark, SCHEMAS[n], *values) for n, values in repeated().items()}
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("_stream-*"))
    got = plans_stored.streamed(Catalog(spark, tables), "agg_conversions_seller", END)
    assert rows(got) == rows(hourly.hourly_aggregate("agg_conversions_seller", *tables.values()))
    (folder,) = set(shared.glob("_stream-*")) - before
    parts = list(folder.glob("checkpoint/state/0/[0-9]*"))
    assert len(parts) >= spark.sparkContext.defaultParallelism
    assert list(folder.glob("checkpoint/state/0/*/*.changelog")) and not list(folder.rglob("checkpoint/state/**/*.delta"))


def test_restart_from_the_checkpoint(spark, few, tmp_path):
    """The run dies after a batch was written and before it was journaled."""
    logs = Logs(spark, tmp_path)
    logs.add(clicks=table(spark, CLICKS, (1, "2024-01-01 00"), (2, "2024-01-01 01"), (3, "2024-01-01 01")))
    commit = HourLedger.commit

    def dies(self, counts, batch=-1):
        raise RuntimeError("lost")

    (clicks,) = logs.streams("clicks")
    try:
        HourLedger.commit = dies
        with pytest.raises(Exception, match="lost"):
            run(clicks, tmp_path)
    finally:
        HourLedger.commit = commit
    assert stored(spark, tmp_path, "auction_id_64 bigint").count() == 0
    logs.add(clicks=table(spark, CLICKS, (4, "2024-01-01 01"), (5, "2024-01-02 00")))
    for _ in range(2):
        run(logs.streams("clicks")[0], tmp_path)
    got = stored(spark, tmp_path, "auction_id_64 bigint")
    assert rows(got.select("auction_id_64", "dh")) == [
        (1, "2024-01-01 00"), (2, "2024-01-01 01"), (3, "2024-01-01 01"), (4, "2024-01-01 01"), (5, "2024-01-02 00"),
    ]
    # Batches of one hour lie beside each other, and a journaled one is not written again.
    ledger = HourLedger(spark, f"{tmp_path}/ledger")
    assert rows(ledger.entries().groupBy("dh").agg(F.sum("n_rows"))) == [("2024-01-01 00", 1), ("2024-01-01 01", 3), ("2024-01-02 00", 1)]
    stream.write_batch(table(spark, CLICKS, (9, "2024-01-01 00")), 0, f"{tmp_path}/out", ledger)
    assert stored(spark, tmp_path, "auction_id_64 bigint").count() == 5


def test_jobs_with_campaigns_need_them(spark, tmp_path, few):
    logs = Logs(spark, tmp_path)
    logs.add(imps=table(spark, IMPS, imp(1, "2024-01-01 05")), bids=table(spark, BIDS, (1, "2024-01-01 05", 0, 8), (1, "2024-01-01 05", 0, 8)),
             clicks=table(spark, CLICKS, (1, "2024-01-01 05")))
    logs.end("imps", "bids", "clicks")
    streams = logs.streams("imps", "bids", "clicks")
    with pytest.raises(ValueError):
        stream.streamed_aggregate("agg_campaign_clicks", *streams)
    result = stream.streamed_aggregate("agg_campaign_clicks", *streams, table(spark, "campaign_id int", (8,)))
    run(result, tmp_path)
    got = stored(spark, tmp_path, columns_of(result)).collect()
    assert [(r.size, r.campaign_id, r.imps, r.clicks) for r in got] == [(75000, 8, 2, 2)]
