"""Per-key lookups over history tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcases.constants import EXCLUDED_VERSION_PATTERNS
from fleetcases.functions.dates import col_of, earlier_of, year_diff


def latest_known(history: DataFrame, key: str, value: str, order: str,
                 exclude_like: Sequence[str] = EXCLUDED_VERSION_PATTERNS, out_key: str | None = None,
                 out_value: str | None = None) -> DataFrame:
    """Per key, the non-null ``value`` of the row latest by ``order``.

    Values matching any ``exclude_like`` pattern are ignored. A null ``order`` counts as the
    latest (descending order puts nulls first, D8); rows tied on ``order`` resolve to the
    greatest value (D18). Two steps: a hash aggregate, partial in every task, brings the history to one
    row per key and value with its latest order; then the first of a key's few values is taken. The
    history itself is never sorted, and a key with a long history never lands whole in one task.
    """
    v = F.col(value)
    keep = v.isNotNull()
    for pattern in exclude_like:
        keep = keep & ~v.like(pattern)
    per_value = (history.filter(keep).groupBy(F.col(key).alias("_key"), v.alias("_value"))
                 .agg(F.max(F.col(order).isNull()).alias("_open"), F.max(order).alias("_order")))
    # values with a row of unknown order are all latest alike: only the value tells them apart
    latest = F.when(~F.col("_open"), F.col("_order"))
    first = Window.partitionBy("_key").orderBy(F.col("_open").desc(), latest.desc(), F.col("_value").desc())
    return (per_value.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
            .select(F.col("_key").alias(out_key or key), F.col("_value").alias(out_value or value)))


def earliest_known(history: DataFrame, key: str, date: str, out_key: str | None = None,
                   out_date: str | None = None) -> DataFrame:
    """Per key, the earliest non-null ``date``."""
    return (history.filter(F.col(date).isNotNull())
            .groupBy(F.col(key).alias(out_key or key))
            .agg(F.min(date).alias(out_date or date)))


def join_ignore_case(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     how: str = "left") -> DataFrame:
    """Equi-join on upper-cased keys (still a hash/sort-merge join on the expression)."""
    return left.join(right, F.upper(left[left_key]) == F.upper(right[right_key]), how)


def device_age_years(installed: str | Column, deployed: str | Column, as_of: dt.date) -> Column:
    """Calendar years from the earlier of two nullable dates to ``as_of``."""
    return year_diff(earlier_of(col_of(installed), col_of(deployed)), F.lit(as_of)).cast("long")
