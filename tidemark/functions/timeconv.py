"""Time units as integers, and calendar helpers.  Going to a finer unit gives the end of the unit (a date
in ms is its last ms), but minute to second gives the start; going to a coarser one truncates.  Calendar
functions use the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = "DMSTW"


def _day_start(date: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(date.cast("string"), "yyyyMMdd"))


def epoch_date(seconds: Column) -> Column:
    """Epoch seconds -> yyyymmdd."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyyMMdd").cast("int")


def convert_unit(value: Column, source: str, target: str) -> Column:
    """``value`` in unit ``source`` (D, M, S, T, W) in unit ``target`` (those and Y)."""
    if source == target:
        return value
    if source == "W":
        return value if target == "W" else convert_unit(F.floor(value / 1000), "T", target)
    if target == "W":
        return convert_unit(value, source, "T") * 1000 + 999
    if target == "Y":
        day = value if source == "D" else convert_unit(value, source, "D")
        return F.floor(day / 10000).cast("int")
    if source == "D":
        last = _day_start(value) + 86399
        return {"T": last * 1000 + 999, "S": last, "M": F.floor(last / 60)}[target].cast("long")
    if source == "M":
        return {"T": value.cast("long") * 60000 + 59999, "S": value.cast("long") * 60, "D": epoch_date(value.cast("long") * 60)}[target]
    if source == "S":
        return {"T": value.cast("long") * 1000 + 999, "M": F.floor(value / 60), "D": epoch_date(value)}[target]
    return {"S": F.floor(value / 1000), "M": F.floor(value / 60000), "D": epoch_date(F.floor(value / 1000))}[target]


def finest(units: list[str]) -> str:
    return max(units, key=ORDER.index)


def hhmmss(ts: Column) -> Column:
    return F.date_format(ts, "HHmmss").cast("int")


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HHmm").cast("int")


def make_time(date: Column, clock: Column, ms: Column | None = None) -> Column:
    """yyyymmdd and hhmmss (and ms) -> timestamp."""
    part = lambda c, d, m: (F.floor(c / d) % m).cast("int")
    sec = (clock % 100).cast("decimal(8,6)") + ((ms / 1000).cast("decimal(8,6)") if ms is not None else F.lit(0).cast("decimal(8,6)"))
    return F.make_timestamp(part(date, 10000, 10000), part(date, 100, 100), part(date, 1, 100), part(clock, 10000, 100), part(clock, 100, 100), sec.cast("decimal(8,6)"))


def clock_seconds(clock: Column) -> Column:
    """hhmmss -> seconds since midnight."""
    return (F.floor(clock / 10000) * 3600 + F.floor(clock / 100) % 100 * 60 + clock % 100).cast("long")


def clock_minutes(clock: Column) -> Column:
    """hhmm -> minutes since midnight."""
    return (F.floor(clock / 100) * 60 + clock % 100).cast("long")


def shift_hhmm(clock: Column, minutes: Column | int) -> Column:
    """hhmm moved by minutes, without a wrap at midnight."""
    m = clock_minutes(clock) + minutes
    return (F.floor(m / 60) * 100 + m % 60).cast("int")


def as_date(date: Column) -> Column:
    return F.to_date(date.cast("string"), "yyyyMMdd")


def date_int(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def weekday(day: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(day) - 1


def next_workday(day: Column) -> Column:
    """The next day that isn't a Saturday or Sunday."""
    return F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))


def whole_range(start: Column, stop: Column) -> Column:
    """Whether a pair of milliseconds means all of time: it is turned about, or both are 0."""
    return (stop < start) | ((stop == 0) & (start == 0))


def parse_ms(s: Column) -> Column:
    """yyyyMMddHHmmssSSS as a timestamp; null where it is none."""
    second = F.try_to_timestamp(F.left(s, F.lit(14)), F.lit("yyyyMMddHHmmss"))
    return F.timestamp_micros(F.unix_micros(second) + F.substr(s, F.lit(15), F.lit(3)).try_cast("long") * 1000)


def embedded_time(s: Column) -> Column:
    """The first run of 8, 12, 14 or 17 digits in a text, as date, minute, second or millisecond; null without one."""
    found = F.regexp_extract(s, r"(?<!\d)(\d{17}|\d{14}|\d{12}|\d{8})(?!\d)", 1)
    return parse_ms(F.when(found != "", F.rpad(found, 17, "0")))
