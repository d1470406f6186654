"""Whole runs: read the named inputs, compute, write the stored tables.

The inputs come from a ``Catalog`` with the names used below. A run may be
repeated; it replaces what it wrote before.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auctionlens.constants import BIG_CAMPAIGN_IMPS, BIG_CPA_CAMPAIGN_IMPS, SITE_MIN_PERF_IMPS
from auctionlens.functions.timeparts import HOUR_FORMAT, as_of_time, hours_of_day
from auctionlens.operators import backfill, campaign_meta, hourly, reporting
from auctionlens.operators.attribution import in_hours
from auctionlens.sources import sinks
from auctionlens.sources.catalog import Catalog
from auctionlens.sources.ledger import HourLedger
from auctionlens.sources.readers import read_through

# Days between an hour and the run that aggregates it: conversions have to
# arrive before theirs.
RUN_DELAY_DAYS = {"clicks": 1, "conversions": 2}


def due_day(name: str, today: str) -> str:
    """The day an hourly job works on when it is run ``today``."""
    delay = RUN_DELAY_DAYS[hourly.JOBS[name].response]
    return (as_of_time(today) - timedelta(days=delay)).strftime("%Y-%m-%d")


def chosen_campaigns(name: str, tables: Catalog, min_imps: int | None = None) -> DataFrame | None:
    """The campaigns a per-campaign job is restricted to."""
    if name == "agg_conversions_campaign":
        floor = BIG_CPA_CAMPAIGN_IMPS if min_imps is None else min_imps
        return hourly.big_cpa_campaigns(tables["categorizer"], tables["quick_stats"], floor)
    if name == "agg_campaign_clicks":
        return hourly.big_campaigns(tables["quick_stats"], BIG_CAMPAIGN_IMPS if min_imps is None else min_imps)
    return None


def aggregate_day(tables: Catalog, name: str, day: str, out: str, min_imps: int | None = None) -> None:
    """One hourly table for all hours of a day."""
    result = hourly.hourly_aggregate(
        name, tables["imps"], tables["bids"], tables[hourly.JOBS[name].response],
        chosen_campaigns(name, tables, min_imps), hours_of_day(day),
    )
    sinks.write_hours(result, out)


def aggregate_four_way_day(tables: Catalog, day: str, out: str) -> None:
    result = hourly.four_way_aggregate(tables["imps"], tables["bids"], tables["clicks"], hours_of_day(day))
    sinks.write_four_way(result, out)


def aggregate_ready_hours(tables: Catalog, as_of: str, out: str, lookback_days: int = 8) -> list[str]:
    """Backfill the auction features: every ready hour in one job. Returns the hours.

    Stored logs are planned from their partition names, and only the hours that come
    out, at most those of the look-back, are looked into for rows.
    """
    logs = ("imps", "bids", "clicks")
    ready = backfill.ready_hours(*(tables.hours(n) for n in (*logs, "aggregated_hours")), as_of, lookback_days)
    ready = backfill.populated(ready, [tables[n] for n in logs])
    hours = sorted(r["dh"] for r in ready.select("dh").collect())
    if hours:
        result = hourly.hourly_aggregate(
            "agg_auction_features", tables["imps"], tables["bids"], tables["clicks"], hours=hours
        )
        sinks.write_hours(result, out, deep=True)
    return hours


def write_tree_campaign_imps(tables: Catalog, hour: str, end_hour: str, out: str) -> None:
    chosen = hourly.tree_campaigns(tables["bid_model"], tables["campaign"])
    rows = hourly.tree_campaign_imps(
        tables["imps"], tables["bids"], tables["pixel_fires"], chosen, end_hour, [hour]
    )
    sinks.write_hours(rows, out, deep=True, compression="snappy")


def export_day(stored: DataFrame, name: str, day: str, out: str) -> None:
    """Text files of one stored table, one folder per hour of the day."""
    rows = stored.where(F.col("dh").isin(hours_of_day(day)))
    sinks.export_day(hourly.hourly_export(rows, hourly.EXPORTS[name][1]), out)


def day_table(stored: DataFrame, name: str, day: str, path: str) -> DataFrame:
    """The day aggregate of a stored table, computed when it is not there yet or its hours have changed."""
    rows = stored.where(F.col("dh").isin(hours_of_day(day)))
    keys = hourly.EXPORTS[name][1]
    return read_through(stored.sparkSession, path, lambda: hourly.day_rollup(rows, keys), [rows], f"{name} {day}")


def write_site_stats(tables: Catalog, day: str, out: str, min_perf_imps: int = SITE_MIN_PERF_IMPS) -> None:
    fact = tables["perf_fact"].where(F.col("ymd") == day)
    sinks.write_days(reporting.site_daily_stats(fact, tables["marketplace"], min_perf_imps), out)


def write_campaign_meta(tables: Catalog, as_of: str, out: str) -> None:
    """Metadata snapshot under the hour of ``as_of``."""
    names = ("pixel", "group_pixel", "campaign_group", "campaign", "currency", "categorizer", "goal")
    rows = campaign_meta.campaign_pixel_meta(*[tables[n] for n in names])
    sinks.write_meta_tsv(rows, out, as_of_time(as_of).strftime(HOUR_FORMAT))


def load_missing_hours(tables: Catalog, name: str, ledger: HourLedger, out: str) -> list[str]:
    """Load the hours of an input that the journal does not have; returns them.

    The rows are written first, hour by hour over what may be there, and counted
    where they were stored; then the hours are journaled. A run that dies before
    that is repeated in full by the next one.
    """
    missing = ledger.missing(tables.hours(name)).where("dh IS NOT NULL")
    hours = sorted(row["dh"] for row in missing.collect())  # one string per calendar hour
    if hours:
        rows = in_hours(tables[name], hours)
        sinks.write_hours(rows, out, deep=True)
        stored = in_hours(tables.spark.read.schema(rows.schema).parquet(out), hours)
        ledger.commit(stored.groupBy("dh").agg(F.count(F.lit(1)).alias("n_rows")))
    return hours
