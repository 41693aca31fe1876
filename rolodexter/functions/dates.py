"""Dates and schedules, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def roc_date(c: Column | str) -> Column:
    """yyyMMdd of the Minguo calendar, marks between digits left out; null if it is no date or not seven digits."""
    bare = F.regexp_replace(col(c).cast("string"), "[^0-9]", "")
    digits = F.when(F.length(bare) == 7, bare)
    year = F.substring(digits, 1, 3).cast("int") + 1911
    return F.try_to_date(F.concat(F.lpad(year.cast("string"), 4, "0"), F.substring(digits, 4, 4)), "yyyyMMdd")


def next_hourly(c: Column | str) -> Column:
    return F.date_trunc("hour", col(c)) + F.expr("INTERVAL 1 HOUR")


def next_daily(c: Column | str, hour: int, minute: int = 0) -> Column:
    due = F.date_trunc("day", col(c)) + F.make_dt_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.when(due > col(c), due).otherwise(due + F.expr("INTERVAL 1 DAY"))


def next_monthly(c: Column | str, day: int, hour: int = 0) -> Column:
    """The next day-th of a month at that hour; short months take their last day."""
    month = F.date_trunc("month", col(c))
    at = lambda m: F.date_trunc("day", F.least(F.date_add(m, day - 1), F.last_day(m)).cast("timestamp_ntz")) + F.make_dt_interval(hours=F.lit(hour))
    this, following = at(month.cast("date")), at(F.add_months(month.cast("date"), 1))
    return F.when(this > col(c), this).otherwise(following)


def is_overdue(last_run: Column | str, due: Column, now: Column) -> Column:
    return (due <= now) & (col(last_run).isNull() | (col(last_run) < due))


def is_fresh(checked_at: Column | str, now: Column, hours: int) -> Column:
    """Within a time to live; 0 hours never ends."""
    return col(checked_at).isNotNull() if hours == 0 else F.coalesce(col(checked_at) >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(False))


def iso_week(c: Column | str) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(c)), F.lit("-W"), F.lpad(F.weekofyear(col(c)).cast("string"), 2, "0"))
