"""Cases from a daily issue log.

A *case* is a run of consecutive days on which a device appears in the log: it starts on the
first day of the run and closes on its last day, unless the run reaches ``as_of`` (still open,
close is null).

The log is first brought to one row per device and day in two aggregates: a hash aggregate counts
equal rows (partial in every map task, so a device that logs a day many times is collapsed before any
shuffle, and the raw log is never sorted); then the few variants left of a day give way to the least.
The second one runs after the shuffle by device that the windows need, on the sort they need: two
shuffles in all.

Where one key holds a large part of the log (a null or placeholder device), ``span_days`` cuts its
days into spans. The variants of a day are then reduced per (device, day) before anything is gathered by
device, windows run per (device, span), and only the spans' first and last days and the boundaries go
through a second window per device, which stitches the spans. The results are the same.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcases.constants import INSTALLED_STATUS
from fleetcases.functions.dates import days_inclusive, min_day

CASE_ATTRS = ("ams_id", "asset_id", "cmh_id", "source_system_id", "device_type")


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def flag_case_boundaries(log: DataFrame, as_of: dt.date, key: str = "asset_id", day: str = "date",
                         first_day: dt.date | None = None, span_days: int | None = None) -> DataFrame:
    """O1: mark the rows that open and close a case, per device in day order.

    Adds ``opens`` (no earlier row, or the previous row is not the day before; this holds for
    every row of the log's first day, so that day needs no test of its own), ``closes`` (no
    later row and the day is not ``as_of``, or the next row is more than a day later) and ``rn``
    (position of the row within its device). Rows of one day are ordered by all their other
    columns, so the flags do not depend on where the rows lie. Rows with a null day can neither
    open nor close a case and are left out. Rows with a null device key form one device, as in
    the source; ``span_days`` keeps a device with a large part of the log out of a single task.
    ``first_day`` is accepted for callers that know it and changes nothing.
    """
    d = F.col(day)
    log = log.filter(d.isNotNull())
    rest = [F.col(c).asc_nulls_first() for c in log.columns if c not in (key, day)]
    if span_days is None:
        w = Window.partitionBy(key).orderBy(d.asc(), *rest)
        rows = (log.withColumn("_prev", F.lag(d).over(w)).withColumn("_next", F.lead(d).over(w))
                .withColumn("rn", F.row_number().over(w)))
    else:
        rows = _stitched_positions(log.withColumn("_span", _span_of(day, span_days)), key, day, rest)
    opens, closes = _flags(d, F.col("_prev"), F.col("_next"), as_of)
    return (rows.withColumn("opens", opens).withColumn("closes", closes)
            .select(*log.columns, "opens", "closes", "rn"))


def _flags(d: Column, prev_day: Column, next_day: Column, as_of: dt.date) -> tuple[Column, Column]:
    """Whether a day opens and closes a case, from the days of the rows beside it."""
    opens = prev_day.isNull() | (F.datediff(d, prev_day) != 1)
    closes = (next_day.isNull() & (d != F.lit(as_of))) | (F.datediff(next_day, d) > 1)
    return _false_if_null(opens), _false_if_null(closes)


def _span_of(day: str, span_days: int) -> Column:
    """Number of the span of days that a day lies in."""
    return F.floor(F.unix_date(F.to_date(day)) / span_days).cast("int")


def _stitched_positions(rows: DataFrame, key: str, day: str, rest: Sequence[Column]) -> DataFrame:
    """``_prev``, ``_next`` (days of the rows beside) and ``rn`` per device: windows per (device, span),
    then one row per span, in a second window per device, says what lies before and after."""
    d = F.col(day)
    w = Window.partitionBy(key, "_span").orderBy(d.asc(), *rest)
    rows = (rows.withColumn("_prev", F.lag(d).over(w)).withColumn("_next", F.lead(d).over(w))
            .withColumn("_at", F.row_number().over(w)))
    spans = rows.groupBy(key, "_span").agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"),
                                           F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(key).orderBy("_span")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col(key).alias("_key"), F.col("_span").alias("_s"), F.lag("_hi").over(by_key).alias("_before"),
                         F.lead("_lo").over(by_key).alias("_after"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"))
    joined = rows.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_s")))
    return (joined.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
            .withColumn("rn", (F.col("_at") + F.col("_rows")).cast("int")))


def _variants(log: DataFrame, key: str, day: str, rest: Sequence[str]) -> DataFrame:
    """Different rows of the log with their number ``_k``: a hash aggregate, partial before the shuffle."""
    return log.filter(F.col(day).isNotNull()).groupBy(key, day, *rest).agg(F.count(F.lit(1)).alias("_k"))


def _days_of(variants: DataFrame, keys: Sequence[str], rest: Sequence[str], dedupe: bool) -> DataFrame:
    """One row per ``keys`` with the least attributes of the variants (nulls first) and ``n``."""
    pick = F.min(F.struct(*rest)) if rest else F.min(F.lit(True))
    n = F.lit(1).cast("long") if dedupe else F.sum("_k")
    days = variants.groupBy(*keys).agg(pick.alias("_a"), (F.max(n) if dedupe else n).alias("n"))
    return days.select(*keys, *(F.col(f"_a.{c}").alias(c) for c in rest), "n")


def _device_days(log: DataFrame, as_of: dt.date, key: str, day: str, attrs: Sequence[str],
                 dedupe: bool, span_days: int | None = None) -> DataFrame:
    """One row per device and day that opens or closes a case or was logged several times: ``n`` (log
    rows of that day, 1 with ``dedupe``), the attributes (the least of the day's rows, all attributes
    together, nulls first), whether its first row opens and its last row closes a case, and
    ``next_close``: the close of the first boundary row (one that opens or closes) on a later day, which
    is what the source's second window hands back.
    """
    rest = [c for c in dict.fromkeys(attrs) if c not in (key, day)]
    variants, d = _variants(log, key, day, rest), F.col(day)
    w = Window.partitionBy(key).orderBy(d.asc())
    prev_day, next_day = F.lag(d).over(w), F.lead(d).over(w)
    if span_days is None:
        # dealt by device once: the aggregate per day and the windows below share this shuffle and its sort
        days = _days_of(variants.repartition(F.col(key)), [key, day], rest, dedupe)
    else:
        days = _days_of(variants, [key, day], rest, dedupe).withColumn("_span", _span_of(day, span_days))
        inner = Window.partitionBy(key, "_span").orderBy(d.asc())
        days = days.withColumn("_prev", F.lag(d).over(inner)).withColumn("_next", F.lead(d).over(inner))
        prev, nxt = F.col("_prev"), F.col("_next")
        # a span's first and last day are kept, so the second window sees the true neighbours of both
        days = days.filter(prev.isNull() | nxt.isNull() | (F.datediff(d, prev) != 1) | (F.datediff(nxt, d) > 1)
                           | (F.col("n") > 1))
        prev_day, next_day = F.coalesce(prev, prev_day), F.coalesce(nxt, next_day)
    days = days.withColumn("_p", prev_day).withColumn("_x", next_day)
    opens, closes = _flags(d, F.col("_p"), F.col("_x"), as_of)
    days = days.select(key, day, *rest, "n", opens.alias("opens"), closes.alias("closes"))
    days = days.filter(F.col("opens") | F.col("closes") | (F.col("n") > 1))
    # the day's first boundary row: its only row, the first of several if that opens, else the
    # second (which opens, as every repeat does); only the day's last row can close
    first_close = F.when(F.col("closes") & ((F.col("n") == 1) | ((F.col("n") == 2) & ~F.col("opens"))), d)
    return days.withColumn("next_close", F.lead(first_close).over(w))


def _day_cases(day: str, single: Column) -> Column:
    """The different (start, close) pairs that a day's rows give. With n = 1 it is ``single``. Of
    several rows the first opens as the day does, all others open; each takes the close of the
    next, which only the last can have, and the last one its own or the next day's."""
    d, n = F.col(day), F.col("n")
    own = F.when(F.col("closes"), d)
    none = F.lit(None).cast("date")

    def pair(when: Column, close: Column) -> Column:
        return F.when(when, F.struct(d.alias("start_date"), close.alias("close_date")))
    before_last = pair((n > 2) | F.col("opens"), own)          # the row before the last
    earlier = pair((n > 3) | ((n > 2) & F.col("opens")), none)  # rows before that one
    last = F.struct(d.alias("start_date"), F.col("last_close").alias("close_date"))
    several = F.array_distinct(F.filter(F.array(earlier, before_last, last), lambda p: p.isNotNull()))
    return F.when(n == 1, F.filter(F.array(single), lambda p: p.isNotNull())).otherwise(several)


def build_cases(log: DataFrame, as_of: dt.date, key: str = "asset_id", day: str = "date",
                attrs: Sequence[str] = CASE_ATTRS, dedupe: bool = True,
                first_day: dt.date | None = None, span_days: int | None = None) -> DataFrame:
    """O2: one row per case (``attrs``, start_date, close_date); close_date null = open.

    A row that opens a case takes its own day as close when it also closes (single-day case),
    else the close day carried by the next boundary row of the device. ``dedupe`` takes one row
    per device and day (D2; attributes that differ within a day: the least); ``dedupe=False``
    lets a repeated day open further cases, by rules on the day's number of rows, so no row is
    copied and none is dropped. ``first_day`` is not needed and changes nothing. ``span_days``
    (see the module) is for logs in which one device holds a large part of the rows.
    """
    days = _device_days(log, as_of, key, day, attrs, dedupe, span_days)
    d = F.col(day)
    days = days.withColumn("last_close", F.when(F.col("closes"), d).otherwise(F.col("next_close")))
    single = F.when(F.col("opens"), F.struct(d.alias("start_date"), F.col("last_close").alias("close_date")))
    return (days.withColumn("_c", F.explode(_day_cases(day, single)))
            .select(*attrs, "_c.start_date", "_c.close_date"))


def build_cases_legacy(log: DataFrame, as_of: dt.date, key: str = "asset_id", day: str = "date",
                       attrs: Sequence[str] = CASE_ATTRS, dedupe: bool = True,
                       first_day: dt.date | None = None, span_days: int | None = None) -> DataFrame:
    """O3: the older case rule, kept for parity with the older view.

    Every boundary row takes the close day of the next boundary row, and a row without a start
    takes the first day of the whole log. Single-day cases lose their close, and a close-only
    row followed by a single-day case becomes a spurious case from the log's first day.
    """
    if first_day is None:
        first_day = min_day(log, day)
    days = _device_days(log, as_of, key, day, attrs, dedupe, span_days).withColumn("last_close", F.col("next_close"))
    d = F.col(day)
    start = F.when(F.col("opens"), d)
    single = F.when(F.col("opens") | F.col("next_close").isNotNull(),
                    F.struct(F.coalesce(start, F.lit(first_day)).alias("start_date"),
                             F.col("next_close").alias("close_date")))
    return (days.withColumn("_c", F.explode(_day_cases(day, single)))
            .select(*attrs, "_c.start_date", "_c.close_date")
            .distinct())


ENRICHED_COLUMNS = ("ams_id", "source_system_id", "cmh_id", "asset_tag", "device_type",
                    "start_date", "close_date", "sku", "software_version", "case_duration",
                    "account_name", "clinic_ranking", "street", "city", "state", "client_id")


def enrich_cases(cases: DataFrame, assets: DataFrame, accounts: DataFrame, devices: DataFrame,
                 as_of: dt.date, installed_status: str = INSTALLED_STATUS) -> DataFrame:
    """Add asset, account and client attributes to each case; installed assets only.

    The asset status test ignores case, and it drops cases without an asset row (the outer
    join to assets is filtered, hence inner). Accounts and devices stay optional; an asset tag
    with several devices yields one row per device. ``case_duration`` counts both end days; an
    open case runs to ``as_of``. Not de-duplicated here: the case table does that once, last.
    """
    # Lookups reduced to distinct rows first: the case table ends in a distinct and gaps count
    # distinct days, so a repeated dimension row changes nothing but the work it would cause.
    a = (assets.filter(F.upper("status") == installed_status.upper())
         .select("ams_id", "asset_tag", "sku").distinct())
    acc = accounts.select("cmh_id", "account_name", F.col("ranking").alias("clinic_ranking"),
                          F.col("billing_street").alias("street"),
                          F.col("billing_city").alias("city"),
                          F.col("billing_state_province").alias("state"))
    dev = devices.select(F.col("asset_id").alias("asset_tag"), "client_id",
                         F.col("device_apk_version").alias("software_version")).distinct()
    # assets and devices grow with the fleet: the planner sees the small size of their compressed files and
    # would send them whole to the driver and every task
    out = (cases.join(a.hint("merge"), "ams_id", "inner")
           .join(acc, "cmh_id", "left")
           .join(dev.hint("merge"), "asset_tag", "left")
           .withColumn("case_duration",
                       days_inclusive("start_date", "close_date", as_of).cast("long")))
    return out.select(*ENRICHED_COLUMNS)
