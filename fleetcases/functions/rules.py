"""Ordered labelling rules and conditional aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetcases.constants import TV_MAKER_RULES
from fleetcases.functions.dates import col_of

__all__ = ["TV_MAKER_RULES", "classify_first_match", "conditional_count",
           "conditional_count_distinct"]


def classify_first_match(c: str | Column, rules: Sequence[tuple[str, str]] = TV_MAKER_RULES,
                         default: Column | None = None) -> Column:
    """Label of the first LIKE rule that matches; else ``default`` (the raw value)."""
    col = col_of(c)
    out = None
    for pattern, label in rules:
        cond = col.like(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    fallback = col if default is None else default
    return fallback if out is None else out.otherwise(fallback)


def conditional_count(cond: Column) -> Column:
    """Rows for which ``cond`` holds (null counts as false)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def conditional_count_distinct(key: str | Column, cond: Column) -> Column:
    """Distinct non-null ``key`` values among rows where ``cond`` holds."""
    return F.count_distinct(F.when(cond, col_of(key)))
