"""Points inside intervals of days, for any width ("left outer equi plus range", SURVEY §2.2).

A range condition beside an equality would otherwise pair all rows that share the equality. Here days are
cut into bins at least as wide as the longest interval, so an interval meets at most two bins and a point
exactly one: the join is an equi-join on (keys, bin) with the range as a filter, and the rows that move
are two per interval and one per point whatever the width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = "_bin"


def bin_of(day: Column, width: int) -> Column:
    """Number of the bin of ``width`` days that a day lies in."""
    return F.floor(F.unix_date(day) / width).cast("int")


def with_bin(points: DataFrame, day: str, width: int) -> DataFrame:
    return points.withColumn(BIN, bin_of(F.col(day), width))


def points_in_intervals(intervals: DataFrame, points: DataFrame, on: Sequence[str], first: Column, last: Column,
                        day: str, width: int, binned: bool = False) -> DataFrame:
    """Inner join: each interval [first, last] (both days included) with the points of equal ``on`` whose
    ``day`` lies in it.

    ``width`` is the number of days of the longest interval or more. ``binned`` points carry their bin of
    that width (``with_bin``): a table bucketed by ``on`` and the bin is then not shuffled. Rows with a
    null key, or without a first or last day, match nothing.
    """
    known = first.isNotNull() & last.isNotNull()
    for c in on:
        known = known & F.col(c).isNotNull()
    left = (intervals.filter(known & (first <= last)).withColumn("_first", first).withColumn("_last", last)
            .withColumn(BIN, F.explode(F.sequence(bin_of(F.col("_first"), width), bin_of(F.col("_last"), width)))))
    right = points if binned else with_bin(points, day, width)
    # both sides grow with the log: dealt by key, whatever the size of their files makes the planner expect
    return (left.join(right.hint("merge"), [*on, BIN]).filter(F.col(day).between(F.col("_first"), F.col("_last")))
            .drop("_first", "_last", BIN))
