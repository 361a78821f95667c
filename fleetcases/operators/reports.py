"""Reports over the case table.

Distinct counts are built as chains of plain aggregates where that removes Spark's ``Expand``
(one copy of every row per distinct expression): first one row per (dims, device), then sums
per dims. Each level aggregates partially before its shuffle, so a dims group holding most of
the rows (one device type, one SKU) arrives at its reducer pre-summed, one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcases.constants import TOTAL_LABEL
from fleetcases.functions.rules import conditional_count


def breakdown_with_total(df: DataFrame, dim: str, measures: Mapping[str, Column],
                         total_label: str = TOTAL_LABEL) -> DataFrame:
    """The measures per ``dim`` value plus one overall row labelled ``total_label``.

    One pass with grouping sets ((dim), ()); the overall row is told apart by ``grouping_id``,
    so a null ``dim`` group stays a group of its own (D7). Equal rows are merged as by UNION.
    """
    names = list(measures)
    g = df.rollup(dim).agg(*[m.alias(n) for n, m in measures.items()],
                           F.grouping_id().alias("_total"))
    label = F.when(F.col("_total") == 1, F.lit(total_label)).otherwise(F.col(dim).cast("string"))
    return g.select(label.alias(dim), *names).distinct()


def _with_share(df: DataFrame, part: str, whole: str, on: bool) -> DataFrame:
    """Optional percentage column (D30: the source worked these out by hand, outside SQL)."""
    if not on:
        return df
    return df.withColumn("pct_missing", F.round(F.col(part) * 100.0 / F.col(whole), 3))


def cases_and_missing(df: DataFrame, dim: str = "device_type",
                      gap: str = "days_with_no_heartbeat", with_share: bool = False) -> DataFrame:
    """Cases and cases with a missing signal day, per ``dim`` and overall."""
    out = breakdown_with_total(df, dim, {
        "total_cases": F.count(F.lit(1)),
        "heartbeat_missing": conditional_count(F.col(gap) > 0),
    })
    return _with_share(out, "heartbeat_missing", "total_cases", with_share)


def devices_and_missing(df: DataFrame, dim: str = "device_type", device: str = "asset_tag",
                        gap: str = "days_with_no_heartbeat",
                        total_label: str = TOTAL_LABEL, with_share: bool = False) -> DataFrame:
    """Devices and devices with a missing-signal case, per ``dim`` and overall.

    Plain aggregates instead of distinct counts over grouping sets (which copy every row once
    per set and per distinct expression): one row per (dim, device) with a missing flag out of one scan,
    then these few rows stand for their dim and for the total, and each device counts once in either, so a
    device seen under two ``dim`` values is one of the total. The total row is told apart by its own
    mark (D7).
    """
    miss = F.max(F.when(F.col(gap) > 0, 1).otherwise(0))
    label = F.col(dim).cast("string")
    per_dim = df.groupBy(dim, device).agg(miss.alias("_miss"))
    sets = F.array(F.struct(F.lit(False).alias("_total"), label.alias(dim)),
                   F.struct(F.lit(True).alias("_total"), F.lit(total_label).alias(dim)))
    both = per_dim.select(device, "_miss", F.explode(sets).alias("_s")).select(device, "_miss", "_s.*")
    known = F.col(device).isNotNull()
    out = (both.groupBy("_total", dim, device).agg(F.max("_miss").alias("_miss"))
           .groupBy("_total", dim).agg(
               F.count(device).alias("total_devices"),
               F.sum(F.when(known, F.col("_miss")).otherwise(0)).cast("long").alias("heartbeat_missing")))
    # an empty table has a total row too
    none = df.sparkSession.range(1).select(F.lit(True).alias("_total"), F.lit(total_label).alias(dim),
                                           F.lit(0).cast("long").alias("total_devices"), F.lit(0).cast("long").alias("heartbeat_missing"))
    out = (out.unionByName(none).groupBy("_total", dim)
           .agg(F.max("total_devices").alias("total_devices"), F.max("heartbeat_missing").alias("heartbeat_missing")))
    return _with_share(out.drop("_total").distinct(), "heartbeat_missing", "total_devices", with_share)


def frequency_of_counts(df: DataFrame, key: str = "asset_tag", counted: str = "start_date",
                        dims: Sequence[str] = (), count_name: str = "case_cnt",
                        keys_name: str = "device_cnt") -> DataFrame:
    """Distinct ``counted`` per key (and dims), then the number of keys per count."""
    per_key = df.groupBy(key, *dims).agg(F.count_distinct(counted).alias(count_name))
    return per_key.groupBy(count_name, *dims).agg(F.count(key).alias(keys_name))


def frequency_of_sums(df: DataFrame, key: str, summed: str, sum_name: str,
                      keys_name: str = "device_cnt") -> DataFrame:
    """O9 over a summed flag: per key the sum, then the number of keys per sum."""
    per_key = df.groupBy(key).agg(F.sum(summed).cast("long").alias(sum_name))
    return per_key.groupBy(sum_name).agg(F.count(key).alias(keys_name))


def _single_case_devices(df: DataFrame, key: str, dim: str, counted: str) -> DataFrame:
    return (df.groupBy(key, dim).agg(F.count_distinct(counted).alias("case_cnt"))
            .filter(F.col("case_cnt") == 1))


def closed_single_case_join(df: DataFrame, key: str = "asset_tag", dim: str = "device_type",
                            counted: str = "start_date", close: str = "close_date") -> DataFrame:
    """O10 (S07): devices with one case per (device, dim) and some closed row of the device.

    The closed rows are matched on the device alone, not on ``dim`` (D20).
    """
    singles = _single_case_devices(df, key, dim, counted)
    closed = df.filter(F.col(close).isNotNull()).select(key).distinct()
    return (singles.join(closed.hint("merge"), key, "left_semi")
            .groupBy("case_cnt", dim).agg(F.count(key).alias("device_cnt")))


def closed_single_case_in(df: DataFrame, key: str = "asset_tag", dim: str = "device_type",
                          counted: str = "start_date", close: str = "close_date") -> DataFrame:
    """O10 (S08): closed rows of devices having a single-case (device, dim) group, by dim."""
    singles = _single_case_devices(df, key, dim, counted).select(key)
    return (df.filter(F.col(close).isNotNull())
            .join(singles.hint("merge"), key, "left_semi")
            .groupBy(dim).agg(F.count_distinct(key).alias("device_cnt")))


def closed_single_case_devices(df: DataFrame, form: str = "join", **kw) -> DataFrame:
    """Single-case devices with a closed case, counted by device type, in the source's
    join form (S07) or IN form (S08)."""
    if form == "join":
        return closed_single_case_join(df, **kw)
    if form == "in":
        return closed_single_case_in(df, **kw)
    raise ValueError(f"form must be 'join' or 'in', not {form!r}")


def case_breakdown(df: DataFrame, dims: Sequence[str], device: str = "asset_tag",
                   case_count: str = "rows", counted: str = "start_date",
                   device_name: str = "dev_cnt", case_name: str = "case_cnt") -> DataFrame:
    """Devices and cases per ``dims``.

    ``case_count="rows"`` counts rows (``count(*)``); ``"distinct"`` counts distinct
    (device, start) pairs, pairs with a null part skipped (D13).
    """
    if case_count == "rows":
        per_dev = df.groupBy(*dims, device).agg(F.count(F.lit(1)).alias("_n"))
        n = F.col("_n")
    elif case_count == "distinct":
        per_dev = df.groupBy(*dims, device).agg(F.count_distinct(counted).alias("_n"))
        n = F.when(F.col(device).isNotNull(), F.col("_n")).otherwise(F.lit(0))
    else:
        raise ValueError(f"case_count must be 'rows' or 'distinct', not {case_count!r}")
    return per_dev.groupBy(*dims).agg(F.count(device).alias(device_name),
                                      F.sum(n).cast("long").alias(case_name))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "n_rows") -> DataFrame:
    """Key values carried by more than one row, with their row count (a QC output)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
            .filter(F.col(name) > 1))


def order_like_source(df: DataFrame, spec: Sequence[str]) -> DataFrame:
    """ORDER BY with the source's null placement (D8): ascending puts nulls last, descending
    (a ``-`` prefix) puts them first. Applied to final report outputs, which are small."""
    cols = [F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last()
            for c in spec]
    return df.orderBy(*cols)


def date_span(df: DataFrame, column: str = "start_date") -> DataFrame:
    """First and last value of a date column."""
    return df.agg(F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))


def reconcile_sku(cases: DataFrame, base_skus: DataFrame, dim: str = "device_type") -> DataFrame:
    """O31 (C2): cases joined to the installed base's SKU codes; the base code wins over the
    case's own SKU, then devices and distinct rows per (SKU, ``dim``)."""
    codes = base_skus.select("sku_code", "asset_tag").distinct()
    rows = (cases.join(codes, "asset_tag", "inner")
            .withColumn("sku_2", F.coalesce(F.col("sku_code"), F.col("sku")))
            .drop("sku_code").distinct())
    return case_breakdown(rows, ["sku_2", dim])
