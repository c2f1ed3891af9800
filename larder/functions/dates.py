"""Local wall-clock text ``YYYY-MM-DDTHH:MM`` and the periods cut from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def logged_at(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def local_date(logged: Column) -> Column:
    return F.substring(logged, 1, 10)


def local_hour(logged: Column) -> Column:
    return F.substring(logged, 12, 2).cast("int")


def days_before(as_of: str | Column, days: int) -> Column:
    """The local date that many days before an explicit as-of date, as text."""
    day = F.lit(as_of) if isinstance(as_of, str) else as_of
    return F.date_sub(F.to_date(day), days).cast("string")


def month_of(date_text: Column) -> Column:
    return F.substring(date_text, 1, 7)


def monday_week(date_text: Column) -> Column:
    """``YYYY-WW`` with weeks starting on Monday and week 00 before the first one."""
    day = F.to_date(date_text)
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return F.concat(F.substring(date_text, 1, 4), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def pinned(date_text: Column, hour: Column) -> Column:
    """The top of an hour of a day."""
    return F.concat(date_text, F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))
