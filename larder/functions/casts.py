"""Tolerant casts for files whose every column arrives as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def safe_int(c: Column) -> Column:
    """``"1100"`` and ``"1100.0"`` both give 1100; anything unreadable gives NULL."""
    return c.try_cast("double").try_cast("bigint")


def safe_float(c: Column) -> Column:
    return c.try_cast("double")


def safe_date(c: Column) -> Column:
    return F.try_to_date(c, "yyyy-MM-dd")


def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column when the release ships it, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def column_containing(columns: Sequence[str], *parts: str, skip: str | None = None) -> str | None:
    """First column whose name holds every part; releases rename these."""
    for name in columns:
        if name != skip and all(part in name.lower() for part in parts):
            return name
    return None
