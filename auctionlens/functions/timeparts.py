"""Hours are ``yyyy-MM-dd HH`` strings; arithmetic never touches the session time zone."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_FORMAT = "%Y-%m-%d %H"


def add_hours(hour: str, n: int) -> str:
    return (datetime.strptime(hour, HOUR_FORMAT) + timedelta(hours=n)).strftime(HOUR_FORMAT)


def hours_of_day(day: str) -> list[str]:
    return [f"{day} {h:02d}" for h in range(24)]


def shift_hour(hour: Column, n: int | Column) -> Column:
    """The hour ``n`` hours later (earlier when negative), as a string again."""
    step = F.lit(n) if isinstance(n, int) else n
    moved = F.concat(hour, F.lit(":00:00")).cast("timestamp_ntz") + F.make_dt_interval(hours=step)
    return moved.cast("string").substr(1, 13)


def with_partition_parts(df: DataFrame, parts: Iterable[str] = ("dy", "dm", "dd"), hour: str = "dh") -> DataFrame:
    width = {"dy": 4, "dm": 7, "dd": 10}
    return df.withColumns({p: F.col(hour).substr(1, width[p]) for p in parts})


def truncate_to_hour(stamp: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` -> the same text with minutes and seconds zeroed."""
    return F.concat(stamp.substr(1, 14), F.lit("00:00"))


def time_grain(hourly: bool, day: str = "ymd", hour: str = "ymdh") -> Column:
    return F.col(hour if hourly else day)


def as_of_time(as_of: str) -> datetime:
    for fmt in ("%Y-%m-%d", HOUR_FORMAT, "%Y-%m-%d %H:%M:%S"):
        try:
            return datetime.strptime(as_of, fmt)
        except ValueError:
            continue
    raise ValueError(f"not a date, hour or time: {as_of!r}")


def looking_back(day: str, as_of: str, days: int, strict: bool = False) -> Column:
    """``day >= as_of - days`` (``>`` when strict) as a literal, pushable comparison.

    A day counts from its midnight, so a cut-off later in the day leaves that
    day out either way.
    """
    cutoff = as_of_time(as_of) - timedelta(days=days)
    text = cutoff.strftime("%Y-%m-%d")
    past_midnight = cutoff.time() != datetime.min.time()
    return F.col(day) > text if strict or past_midnight else F.col(day) >= text
