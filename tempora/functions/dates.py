"""Durations, dates, times and time zones as the query language has them.

Year-month durations are ``INTERVAL YEAR TO MONTH``, day-time durations
``INTERVAL DAY TO SECOND``; times of day are the day-time duration since
midnight.  A value with a time zone is a struct of its local reading and the
zone's offset in minutes (null: none given).  All are built-in expressions.
Nulls in give nulls out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import round_up_ties

DAY_SECONDS = 86_400

# --- making and measuring ---------------------------------------------------------------------


def year_month(months: Column) -> Column:
    return F.make_ym_interval(F.lit(0), months.cast("int"))


def day_time(seconds: Column) -> Column:
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def months_of(duration: Column) -> Column:
    """All of a year-month duration, in months."""
    return F.extract(F.lit("YEAR"), duration).cast("long") * 12 + F.extract(F.lit("MONTH"), duration).cast("long")


def seconds_of(duration: Column) -> Column:
    """All of a day-time duration, in seconds."""
    part = lambda p: F.extract(F.lit(p), duration)
    return ((part("DAY").cast("long") * 24 + part("HOUR").cast("long")) * 60 + part("MINUTE").cast("long")) * 60 + part("SECOND").cast("decimal(18,6)")


def component(duration: Column, part: str) -> Column:
    """years, months; days, hours, minutes, seconds of a duration; negative ones have negative components."""
    return F.extract(F.lit(part.rstrip("s").upper()), duration)


# --- arithmetic -------------------------------------------------------------------------------


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply_months(duration: Column, by: Column) -> Column:
    """Whole months, ties upwards."""
    return year_month(round_up_ties(months_of(duration) * by))


def divide_months(duration: Column, by: Column) -> Column:
    return year_month(round_up_ties(F.try_divide(months_of(duration).cast("double"), by)))


def multiply_seconds(duration: Column, by: Column) -> Column:
    return day_time(F.round(seconds_of(duration).cast("double") * by, 6))


def divide_seconds(duration: Column, by: Column) -> Column:
    return day_time(F.round(F.try_divide(seconds_of(duration).cast("double"), by), 6))


def months_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(months_of(a).cast("double"), months_of(b).cast("double"))


def seconds_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(seconds_of(a).cast("double"), seconds_of(b).cast("double"))


# --- times of day -----------------------------------------------------------------------------


def time_of(ts: Column) -> Column:
    """A timestamp's time of day."""
    return day_time(seconds_into_day(ts))


def seconds_into_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def time_plus(time: Column, duration: Column) -> Column:
    """A time of day later or earlier, around midnight if need be."""
    return day_time(F.pmod(seconds_of(time) + seconds_of(duration), F.lit(DAY_SECONDS)))


def time_minus(a: Column, b: Column) -> Column:
    return a - b


# --- time zones -------------------------------------------------------------------------------


def parse_zone(text: Column) -> Column:
    """Minutes of a trailing ``Z``, ``+hh:mm`` or ``-hh:mm``; null if there is none."""
    sign = F.when(F.regexp_extract(text, r"([+-])\d\d:\d\d$", 1) == "-", -1).otherwise(1)
    part = lambda k: F.regexp_extract(text, r"[+-](\d\d):(\d\d)$", k).try_cast("int")
    return F.when(text.endswith("Z"), 0).otherwise(sign * (part(1) * 60 + part(2)))


def zoned(local: Column, zone: Column) -> Column:
    return F.struct(local.alias("local"), zone.cast("int").alias("zone"))


def parse_datetime(text: Column) -> Column:
    """``yyyy-mm-ddThh:mm:ss`` with a time zone or none."""
    return zoned(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"), parse_zone(text))


def parse_date(text: Column) -> Column:
    """``yyyy-mm-dd`` with a time zone or none; its local reading is that day's midnight."""
    return zoned(F.substring(text, 1, 10).try_cast("date").cast("timestamp_ntz"), parse_zone(F.substring(text, 11, 6)))


def parse_time(text: Column) -> Column:
    """``hh:mm:ss`` with a time zone or none; its local reading is on the first of January 1972."""
    return zoned(F.try_to_timestamp(F.concat(F.lit("1972-01-01 "), F.substring(text, 1, 8))).cast("timestamp_ntz"), parse_zone(text))


def zone_of(value: Column) -> Column:
    """The time zone as a day-time duration."""
    return day_time(value["zone"] * 60)


def adjust(value: Column, minutes: Column | None) -> Column:
    """The same instant as read in another time zone; a value without a zone gets it, None takes the zone away."""
    if minutes is None:
        return zoned(value["local"], F.lit(None))
    shift = F.coalesce(minutes - value["zone"], F.lit(0))
    return zoned(value["local"] + day_time(shift * 60), minutes)


def adjust_date(value: Column, minutes: Column | None) -> Column:
    out = adjust(value, minutes)
    return zoned(F.date_trunc("DAY", out["local"]).cast("timestamp_ntz"), out["zone"])


def instant(value: Column, implicit: int = 0) -> Column:
    """As read in UTC; values without a zone are in the implicit one.  Orders and equates values whatever their zones."""
    return value["local"] - day_time(F.coalesce(value["zone"], F.lit(implicit)) * 60)


def time_instant(value: Column, implicit: int = 0) -> Column:
    """Of a time of day: on one and the same day, so that zones compare."""
    return instant(value, implicit)


# --- parts of the calendar --------------------------------------------------------------------

_GREGORIAN = {"gYearMonth": "yyyy-MM", "gYear": "yyyy", "gMonthDay": "--MM-dd", "gMonth": "--MM", "gDay": "---dd"}


def gregorian(ts: Column, kind: str) -> Column:
    """The part of a date that ``gYearMonth``, ``gYear``, ``gMonthDay``, ``gMonth`` or ``gDay`` keeps, as text."""
    return F.date_format(ts, _GREGORIAN[kind])


def gregorian_equal(a: Column, b: Column, kind: str) -> Column:
    return gregorian(a, kind) == gregorian(b, kind)
