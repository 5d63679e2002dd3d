"""Local time from UTC seconds: offsets, dates, clock minutes and summer-time switches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def zone_offset(ts: Column, zone: str) -> Column:
    """Minutes that the zone is ahead of UTC at an instant in epoch seconds."""
    local = F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(ts), zone))
    return F.floor((local - ts) / 60).cast("int")


def local_seconds(ts: Column, offset_min: Column) -> Column:
    return ts + offset_min * 60


def local_date(ts: Column, offset_min: Column | int = 0) -> Column:
    off = F.lit(offset_min) if isinstance(offset_min, int) else offset_min
    return F.date_from_unix_date(F.floor((ts + off * 60) / DAY).cast("int"))


def clock_minute(ts: Column, offset_min: Column) -> Column:
    """Minutes after local midnight, 0 to 1439."""
    return F.floor(F.pmod(ts + offset_min * 60, F.lit(DAY)) / 60).cast("int")


def last_sunday(year: Column, month: int) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(end, F.dayofweek(end) - 1)


def in_eu_summer(ts: Column) -> Column:
    """Between the last Sundays of March and October, 01:00 UTC, of the UTC year."""
    year = F.year(local_date(ts))
    at = lambda month: F.unix_date(last_sunday(year, month)).cast("long") * DAY + 3600
    return (ts >= at(3)) & (ts < at(10))


def near_eu_switch(day: Column, tolerance_days: int = 1) -> Column:
    year = F.year(day)
    near = lambda month: F.abs(F.datediff(day, last_sunday(year, month))) <= tolerance_days
    return near(3) | near(10)


def age_on(day: Column, age: float, as_of: str) -> Column:
    return F.lit(float(age)) - F.datediff(F.lit(as_of).cast("date"), day) / F.lit(365.25)


def format_clock(minute: Column) -> Column:
    """H:MM of minutes after midnight, to the nearest minute."""
    m = F.pmod(F.round(minute).cast("int"), F.lit(1440))
    return F.concat(F.floor(m / 60).cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def format_duration(minutes: Column) -> Column:
    """HhMM of a duration in minutes."""
    m = F.round(minutes).cast("int")
    return F.concat(F.floor(m / 60).cast("string"), F.lit("h"), F.lpad((m % 60).cast("string"), 2, "0"))


def epoch_unit(value: Column, seconds_from: float = 3e8) -> Column:
    """The unit an integer epoch is probably in: s, ms, us or ns; null below."""
    v = F.abs(value.cast("double"))
    return (
        F.when(v >= seconds_from * 1e9, "ns").when(v >= seconds_from * 1e6, "us").when(v >= seconds_from * 1e3, "ms").when(v >= seconds_from, "s")
    )


def local_iso(ts: Column, zone: str) -> Column:
    """Local date and time to the minute, as ISO text."""
    off = zone_offset(ts, zone)
    minute = clock_minute(ts, off)
    return F.concat(local_date(ts, off).cast("string"), F.format_string(" %02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int")))


def format_signed(value: Column, places: int = 0) -> Column:
    """A number to so many places with its sign, plus included; null stays null.

    As C's printf has it, and unlike Java's formatter: the exact double is rounded, halves to even, and what
    is less than nothing keeps its minus even where its digits are all 0.
    """

    def written(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series([None if null else f"{x:+.{places}f}" for x, null in zip(numbers["v"], numbers["null"], strict=True)], dtype=object)

    # beside the number, whether it is null, which pandas cannot tell from NaN
    return F.pandas_udf(written, "string", F.PandasUDFType.SCALAR_ITER)(F.struct(value.cast("double").alias("v"), value.isNull().alias("null")))
