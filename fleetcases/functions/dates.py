"""Date helpers with the source's calendar semantics.

Spark's own ``datediff(DAY, ts, ts)`` counts whole 24 h spans and ``datediff(YEAR, ..)`` whole
years; the source counts calendar boundaries. These helpers always work on calendar dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c: str | Column) -> Column:
    """Calendar day of a date or timestamp (in place of ``to_char(ts, 'yyyy-mm-dd')``)."""
    return F.to_date(col_of(c))


def day_diff(start: str | Column, end: str | Column) -> Column:
    """Number of day boundaries from ``start`` to ``end`` (end - start, signed)."""
    return F.datediff(day_of(end), day_of(start))


def year_diff(start: str | Column, end: str | Column) -> Column:
    """Number of calendar-year boundaries from ``start`` to ``end``."""
    return F.year(col_of(end)) - F.year(col_of(start))


def days_inclusive(start: str | Column, close: str | Column, as_of: dt.date) -> Column:
    """Length of a case in days, both ends counted; an open case runs to ``as_of``."""
    return day_diff(start, F.coalesce(col_of(close), F.lit(as_of))) + 1


def earlier_of(a: str | Column, b: str | Column) -> Column:
    """The earlier of two nullable dates; null only when both are null."""
    return F.least(col_of(a), col_of(b))


def as_of_filter(df: DataFrame, column: str, bounds, shift_days: int = 1) -> DataFrame:
    """Rows whose ``column`` shifted back by ``shift_days`` falls on or before every bound.

    All bounds are upper bounds, so the lowest one decides (D5). The test is applied to the raw
    column against a shifted literal so that it reaches the parquet scan as a pushed filter.
    """
    if not isinstance(bounds, (list, tuple)):
        bounds = [bounds]
    bound = min(bounds)
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.DateType):
        return df.filter(F.col(column) <= F.lit(bound + dt.timedelta(days=shift_days)))
    # timestamp: day(ts) - shift <= bound  <=>  ts < midnight of bound + shift + 1
    limit = dt.datetime.combine(bound + dt.timedelta(days=shift_days + 1), dt.time())
    return df.filter(F.col(column) < F.lit(limit).cast(dtype))


def day_span(df: DataFrame, day: str) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a log: one global aggregate, two values come back to the driver.

    They are then plain literals, so filters built from them are pushed into later scans.
    """
    row = df.agg(F.min(day_of(day)).alias("lo"), F.max(day_of(day)).alias("hi")).first()
    return row["lo"], row["hi"]


def log_span(log: DataFrame, day: str, key: str) -> tuple[dt.date | None, dt.date | None, bool]:
    """``day_span`` and, out of the same aggregate, whether any row lacks its ``key``."""
    row = log.agg(F.min(day_of(day)).alias("lo"), F.max(day_of(day)).alias("hi"),
                  F.max(F.col(key).isNull()).alias("unknown")).first()
    return row["lo"], row["hi"], bool(row["unknown"])


def min_day(df: DataFrame, day: str) -> dt.date | None:
    """Smallest day of a log (see ``day_span``)."""
    return day_span(df, day)[0]
