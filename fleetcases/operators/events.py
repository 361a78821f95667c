"""Interventions (remote reboots) and hosts: O19-O27, O29.

Reboot extract columns: asset_id, client_id, reboot_time (text, may be blank). The attached
table (O22) has the case columns plus reboot_date, reboot_flag, days_btw_reboot_new_case.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcases.constants import (CASE_DEVICE_TYPE, DONE_STATUSES, LINUX_PLAYER_TYPE,
                                  REBOOT_SCRIPT_ID, REBOOT_TAG_PATTERN, REPEAT_HORIZON_DAYS,
                                  TV_MAKER_RULES)
from fleetcases.functions.dates import day_diff
from fleetcases.functions.rules import classify_first_match


def _ts(value, df: DataFrame, column: str) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)


def event_day(text: str | Column) -> Column:
    """Day of a timestamp kept as text; blank or malformed text gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.to_date(F.try_to_timestamp(c))


def latest_activity_per_device(activities: DataFrame, since: dt.datetime,
                               script_id: int = REBOOT_SCRIPT_ID,
                               statuses: Sequence[str] = DONE_STATUSES) -> DataFrame:
    """Activities whose id is the latest id of some device for ``script_id`` since
    ``since``, and whose status is one of ``statuses``."""
    recent = activities.filter((F.col("script_id") == script_id)
                               & (F.col("created_at") > _ts(since, activities, "created_at")))
    latest_ids = recent.groupBy("device_id").agg(F.max("id").alias("id")).select("id")
    return (activities.join(latest_ids, "id", "left_semi")
            .filter(F.col("status").isin(*statuses)))


def tagged_events(taggings: DataFrame, tags: DataFrame, since: dt.datetime,
                  pattern: str = REBOOT_TAG_PATTERN) -> DataFrame:
    """Distinct (id, reboot_time) of entities tagged with a tag named like ``pattern``."""
    wanted = tags.filter(F.col("name").like(pattern)).select(F.col("id").alias("tag_id"))
    return (taggings.filter(F.col("created_at") > _ts(since, taggings, "created_at"))
            .join(wanted, "tag_id", "left_semi")
            .select(F.col("taggable_id").alias("id"), F.col("created_at").alias("reboot_time"))
            .distinct())


def earliest_reboot(devices: DataFrame, activities: DataFrame, taggings: DataFrame,
                    tags: DataFrame, since: dt.datetime,
                    device_type: str = LINUX_PLAYER_TYPE) -> DataFrame:
    """O21 (S20): earliest reboot tag time over players with a finished latest reboot run.

    The source's outer join to tags only adds null times, which a minimum ignores, so only the
    devices that qualify are needed, as a semi join.
    """
    players = devices.filter(F.col("type") == device_type).select("id")
    runs = latest_activity_per_device(activities, since).select(F.col("device_id").alias("id"))
    qualified = players.join(runs, "id", "left_semi")
    return (tagged_events(taggings, tags, since).join(qualified, "id", "left_semi")
            .agg(F.min("reboot_time").alias("earliest_reboot_time")))


def attach_events(cases: DataFrame, devices: DataFrame, reboots: DataFrame, as_of: dt.date,
                  device_type: str = CASE_DEVICE_TYPE) -> DataFrame:
    """O22 (S22): every case of ``device_type`` with each reboot of its asset's clients.

    ``reboot_flag`` = 1 when the reboot day lies within [start, close or ``as_of``];
    ``days_btw_reboot_new_case`` = start - reboot day (signed). Cases without a device or a
    reboot keep one row with null reboot columns.

    The table is by definition one row per (case, reboot day) of the same client. With reboots
    reduced to distinct days first, a client contributes at most (its cases) x (its reboot
    days) rows, both bounded by the days in the period, whatever the volume of raw rows.
    """
    cols = cases.columns
    # Both lookups reduced to the distinct pairs the result can see (the output is distinct):
    # a client with many reboot rows on one day multiplies its cases once per day, not per row.
    dev = (devices.select(F.col("asset_id").alias("asset_tag"), F.col("client_id").alias("_client"))
           .distinct())
    rb = (reboots.select(F.col("client_id").alias("_client"),
                         event_day("reboot_time").alias("reboot_date"))
          .distinct())
    rd, start = F.col("reboot_date"), F.col("start_date")
    inside = (rd >= start) & (rd <= F.coalesce(F.col("close_date"), F.lit(as_of)))
    return (cases.filter(F.col("device_type") == device_type)
            .join(dev, "asset_tag", "left")
            .join(rb, "_client", "left")
            .select(*cols, rd,
                    F.when(inside, F.lit(1)).otherwise(F.lit(0)).alias("reboot_flag"),
                    day_diff(rd, start).cast("long").alias("days_btw_reboot_new_case"))
            .distinct())


def first_case_after_event(attached: DataFrame) -> DataFrame:
    """Per (asset, reboot day), the earliest case that starts strictly later.

    A forward as-of match expressed as a grouped minimum, over the rows of O22. ``next_case_after``
    gives the same without them.
    """
    return (attached.filter(F.col("days_btw_reboot_new_case") > 0)
            .groupBy("asset_tag", "reboot_date").agg(F.min("start_date").alias("start_date"))
            .withColumn("days_btw_reboot_new_case",
                        day_diff("reboot_date", "start_date").cast("long")))


def next_case_after(cases: DataFrame, devices: DataFrame, reboots: DataFrame,
                    device_type: str = CASE_DEVICE_TYPE) -> DataFrame:
    """O23 without O22: a forward as-of match on one merged timeline per asset.

    Case starts and reboot days (each once) are one stream per asset, read from the last day back: a
    reboot takes the start seen last, which is the first one after it; on one day the reboot is read before
    the case, so the match is strictly later (D26). Rows: one per different start and reboot day, no case
    x reboot pairs. Returns asset_tag, reboot_date, start_date, days_btw_reboot_new_case and ``reboots``
    (reboot days of the asset).
    """
    starts = (cases.filter((F.col("device_type") == device_type) & F.col("asset_tag").isNotNull())
              .select("asset_tag", "start_date").distinct())
    owners = devices.select(F.col("asset_id").alias("asset_tag"), F.col("client_id").alias("_client")).distinct()
    days = (reboots.select(F.col("client_id").alias("_client"), event_day("reboot_time").alias("reboot_date"))
            .filter(F.col("reboot_date").isNotNull()).distinct()
            .join(owners, "_client").select("asset_tag", "reboot_date").distinct())
    line = (starts.select("asset_tag", F.col("start_date").alias("_day"), "start_date", F.lit(None).cast("date").alias("reboot_date"))
            .unionByName(days.select("asset_tag", F.col("reboot_date").alias("_day"), F.lit(None).cast("date").alias("start_date"),
                                     "reboot_date")))
    back = Window.partitionBy("asset_tag").orderBy(F.col("_day").desc(), F.col("reboot_date").isNull())
    whole = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = (line.withColumn("start_date", F.last("start_date", ignorenulls=True).over(
                  back.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("reboots", F.count("reboot_date").over(whole)))
    return (merged.filter(F.col("reboot_date").isNotNull() & F.col("start_date").isNotNull())
            .select("asset_tag", "reboot_date", "start_date",
                    day_diff("reboot_date", "start_date").cast("long").alias("days_btw_reboot_new_case"), "reboots"))


def _counts_as_repeat(first: DataFrame, horizon: int) -> DataFrame:
    """O24's rule: an asset with one reboot day keeps its match; an asset with several keeps a match only
    when the case starts fewer than ``horizon`` days after the reboot (D27)."""
    n = F.col("reboots")
    return first.filter((n == 1) | ((n > 1) & (F.col("days_btw_reboot_new_case") < horizon)))


def repeat_after_event(attached: DataFrame, horizon: int = REPEAT_HORIZON_DAYS) -> DataFrame:
    """The O23 matches that count as a repeat case."""
    reboots = (attached.groupBy("asset_tag")
               .agg(F.count_distinct("reboot_date").alias("reboots")))
    return _counts_as_repeat(first_case_after_event(attached).join(reboots, "asset_tag", "inner"), horizon)


def repeat_cases(cases: DataFrame, devices: DataFrame, reboots: DataFrame, horizon: int = REPEAT_HORIZON_DAYS,
                 device_type: str = CASE_DEVICE_TYPE) -> DataFrame:
    """O24 by the merged timeline: the rows of ``repeat_after_event``, without the table of O22."""
    return _counts_as_repeat(next_case_after(cases, devices, reboots, device_type), horizon)


def histogram_of(repeats: DataFrame) -> DataFrame:
    """S23 over the rows of O24: devices and cases by days from reboot to the next case."""
    per_dev = repeats.groupBy("days_btw_reboot_new_case", "asset_tag").agg(
        F.count_distinct("start_date").alias("_n"))
    return per_dev.groupBy("days_btw_reboot_new_case").agg(
        F.count("asset_tag").alias("device_cnt"), F.sum("_n").cast("long").alias("case_cnt"))


def totals_of(repeats: DataFrame) -> DataFrame:
    """S32 over the rows of O24: devices and cases with a repeat case."""
    per_dev = repeats.groupBy("asset_tag").agg(F.count_distinct("start_date").alias("_n"))
    return per_dev.agg(F.count("asset_tag").alias("device_cnt"),
                       F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("case_cnt"))


def repeat_histogram(attached: DataFrame, horizon: int = REPEAT_HORIZON_DAYS) -> DataFrame:
    """S23 from the table of O22."""
    return histogram_of(repeat_after_event(attached, horizon))


def repeat_totals(attached: DataFrame, horizon: int = REPEAT_HORIZON_DAYS) -> DataFrame:
    """S32 from the table of O22."""
    return totals_of(repeat_after_event(attached, horizon))


def distinct_per(df: DataFrame, dims: Sequence[str], key: str, name: str = "device_cnt") -> DataFrame:
    """Distinct ``key`` values per ``dims`` (or overall): the counting step of O25."""
    return df.groupBy(*dims).agg(F.count_distinct(key).alias(name))


def event_profile(events: DataFrame, dims: Sequence[str] = (), key: str = "asset_id",
                  keep: DataFrame | None = None, keep_key: str | None = None,
                  name: str = "device_cnt") -> DataFrame:
    """Distinct ``key`` values per ``dims`` (or overall), optionally only for keys found in
    ``keep`` (a semi join on its distinct ``keep_key`` values, e.g. assets that have a case)."""
    if keep is not None:
        kept = keep.select(F.col(keep_key or key).alias(key)).distinct()
        events = events.join(kept, key, "left_semi")
    return distinct_per(events, dims, key, name)


def cohort_masks(df: DataFrame, key: str, cohorts: Sequence[Column], out: str | None = None) -> DataFrame:
    """Cohort algebra in one scan: per key the bits of the cohorts that any of its rows belongs to (bit
    i: condition i). The or-ing is partial in every task, so one row per key and task moves."""
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cohorts)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return (df.select(F.col(key).alias(out or key), mask.alias("mask")).filter("mask <> 0")
            .groupBy(out or key).agg(F.bit_or("mask").alias("mask")))


def in_all(masks: DataFrame, n: int) -> DataFrame:
    """Keys that belong to all ``n`` cohorts."""
    return masks.filter(F.col("mask") == (1 << n) - 1).drop("mask")


def cohort_overlap(a: DataFrame, b: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """Distinct keys present in both sets (INTERSECT, a null key counts as equal to a null key), as
    one or-ed bit mask per key over both."""
    name = out or key
    both = (a.select(F.col(key).alias(name), F.lit(0).alias("side"))
            .unionByName(b.select(F.col(key).alias(name), F.lit(1).alias("side"))))
    return in_all(cohort_masks(both, name, [F.col("side") == 0, F.col("side") == 1]), 2)


def span_overlap_check(attached: DataFrame) -> DataFrame:
    """O27 (S33): assets whose first or last reboot day falls between their first and last
    case start."""
    per = attached.groupBy("asset_tag").agg(
        F.min("start_date").alias("s0"), F.max("start_date").alias("s1"),
        F.min("reboot_date").alias("r0"), F.max("reboot_date").alias("r1"))
    s0, s1 = F.col("s0"), F.col("s1")
    hit = (F.col("r0").between(s0, s1)) | (F.col("r1").between(s0, s1))
    # one row per asset already: a plain count of the non-null tags
    return per.filter(hit).agg(F.count("asset_tag").alias("device_cnt"))


def recently_seen_hosts(hosts: DataFrame, bags: DataFrame, polls: DataFrame,
                        since: dt.datetime,
                        rules: Sequence[tuple[str, str]] = TV_MAKER_RULES) -> DataFrame:
    """O29 (S34): active hosts with screens and a poll since ``since``, with the TV maker
    taken from their profile bag name by the ordered rules (O28)."""
    live = hosts.filter(F.col("active") & (F.col("nscreens") > 0))
    # distinct host ids, map-side first: a host polling all day is one row per task
    recent = (polls.filter(F.col("poll_last_utc") >= _ts(since, polls, "poll_last_utc"))
              .select(F.col("client_resource_id").alias("id")).distinct())
    bag = bags.select(F.col("id").alias("config_profile_bag_id"), F.col("name").alias("_bag"))
    return (live.join(bag, "config_profile_bag_id", "inner")
            .join(recent, "id", "left_semi")
            .select(F.col("id").alias("broad_sign_id"),
                    classify_first_match("_bag", rules).alias("tv_manufacturer"))
            .distinct())
