"""Signal days missing just before a case.

For each case, the days in the lookback window before its start on which the device sent a
primary signal (heartbeat); when there are none, the days with a fallback signal (monitor poll).
Result: ``lookback - days``.

Window edges follow the source exactly (D3, D4): heartbeats are timestamps compared with the
start *date*, so the primary window admits day ``start - lookback - 1`` after its midnight,
and days up to ``start - 1``; polls are compared by day, days ``start - lookback`` to
``start - 1``. Heartbeats before the log's first day and polls before that day minus
``lookback + 1`` are ignored. ``strict_days=True`` gives both signals the plain window.

Scale shape: no heartbeat x poll product and no pairs of a client's cases and signals. Each signal is
first reduced to one row per (client, day) with a partial aggregate (the raw signal tables are the
largest inputs); ``signal_days`` keeps that table so that all users share one scan. Cases and signal
days meet in an interval join by bins (``intervals``), whose rows do not grow with the lookback. The days
seen are bits of their distance from the case's start, or-ed per case in one hash aggregate that is partial
before its shuffle: no distinct over the matches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.constants import LOOKBACK_DAYS, SIGNAL_BIN_DAYS
from fleetcases.operators.intervals import BIN, points_in_intervals, with_bin

# The source groups its count by these five case columns (not by client): a case whose asset
# tag maps to several clients counts the days of all of them together.
CASE_KEY = ("asset_tag", "source_system_id", "start_date", "close_date", "case_duration")


def daily_last_signal(signals: DataFrame, entity: str, ts: str, since: dt.datetime | None = None,
                      until: dt.datetime | None = None) -> DataFrame:
    """(entity, day, last_ts): one row per entity and day with the latest signal time."""
    s = signals.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"))
    ts_type = s.schema["ts"].dataType
    if since is not None:
        s = s.filter(F.col("ts") >= F.lit(since).cast(ts_type))
    if until is not None:
        s = s.filter(F.col("ts") < F.lit(until).cast(ts_type))
    return (s.filter(F.col("entity").isNotNull() & F.col("ts").isNotNull())
            .groupBy("entity", F.to_date("ts").alias("day"))
            .agg(F.max("ts").alias("last_ts")))


PRIMARY, FALLBACK = 0, 1


def signal_days(primary: DataFrame, fallback: DataFrame, primary_entity: str = "client_id",
                primary_ts: str = "created_at", fallback_entity: str = "client_resource_id",
                fallback_ts: str = "poll_last_utc", since: tuple = (None, None), until: dt.datetime | None = None) -> DataFrame:
    """Both signals in one table, one row per signal, entity and day: signal (``PRIMARY`` or ``FALLBACK``),
    entity, day, last_ts and the day's bin. Kept and bucketed by ``SIGNAL_KEYS`` it serves all users
    (``missing_signal_days(..., days=...)``). ``since`` and ``until`` prune the scans."""
    a = daily_last_signal(primary, primary_entity, primary_ts, since[0], until)
    b = daily_last_signal(fallback, fallback_entity, fallback_ts, since[1], until)
    both = (a.select(F.lit(PRIMARY).alias("signal"), "entity", "day", "last_ts")
            .unionByName(b.select(F.lit(FALLBACK).alias("signal"), "entity", "day", "last_ts")))
    return with_bin(both, "day", SIGNAL_BIN_DAYS)


#: what cases and signal days meet on
SIGNAL_KEYS = ("signal", "entity", BIN)
#: distances from the start held by one long of bits
_WORD = 62


def missing_signal_days(cases: DataFrame, primary: DataFrame | None, fallback: DataFrame | None,
                        first_day: dt.date, lookback: int = LOOKBACK_DAYS, strict_days: bool = False,
                        last_day: dt.date | None = None, case_key: Sequence[str] = CASE_KEY,
                        primary_entity: str = "client_id", primary_ts: str = "created_at",
                        fallback_entity: str = "client_resource_id",
                        fallback_ts: str = "poll_last_utc",
                        case_primary_entity: str = "client_id",
                        case_fallback_entity: str = "source_system_id",
                        days: DataFrame | None = None) -> DataFrame:
    """``case_key`` columns + ``days_with_no_heartbeat`` (may be -1 under D3).

    ``cases`` needs the ``case_key`` columns and both entity columns. ``last_day`` (latest case
    start) only prunes the signal scans; it does not change the result. ``days`` is the kept table of
    ``signal_days``; without it that table is worked out from the raw signals.
    """
    key = list(case_key)
    far = lookback if strict_days else lookback + 1
    kept = days is not None
    # an empty log has no first day: then there are no cases and no cut-off to apply
    cut = (first_day, first_day - dt.timedelta(days=lookback + 1)) if first_day else (None, None)
    if kept:
        if first_day:
            days = days.filter(F.col("day") >= F.when(F.col("signal") == PRIMARY, F.lit(cut[0])).otherwise(F.lit(cut[1])))
        if last_day:
            days = days.filter(F.col("day") < F.lit(last_day))
    else:
        midnights = tuple(dt.datetime.combine(c, dt.time()) if c else None for c in cut)
        days = signal_days(primary, fallback, primary_entity, primary_ts, fallback_entity, fallback_ts, midnights,
                           dt.datetime.combine(last_day, dt.time()) if last_day else None)
    # the table's bins serve windows up to their own width; wider ones make bins of theirs
    binned = far <= SIGNAL_BIN_DAYS
    if not binned:
        days = days.drop(BIN)
    kind, start = days.schema["entity"].dataType, F.col("start_date")
    ends = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(c).cast(kind).alias("entity"), F.lit(n).alias("first"))
                     for s, c, n in ((PRIMARY, case_primary_entity, far), (FALLBACK, case_fallback_entity, lookback))))
    windows = cases.withColumn("_s", F.explode(ends)).select(*key, "_s.*")
    seen = points_in_intervals(windows, days, ["signal", "entity"], F.date_sub(start, F.col("first")),
                               F.date_sub(start, 1), "day", SIGNAL_BIN_DAYS if binned else far, binned)
    if not strict_days:
        # the farthest day counts only for a heartbeat after its midnight (ts > date)
        edge = (F.col("signal") == PRIMARY) & (F.col("day") == F.date_sub("start_date", far))
        seen = seen.filter(~edge | (F.col("last_ts") > F.col("day").cast(days.schema["last_ts"].dataType)))

    # the days seen as bits of their distance from the start; a case without a signal keeps a mark
    away = F.datediff("start_date", "day")
    bit = F.expr(f"shiftleft(1L, pmod(datediff(start_date, day), {_WORD}))")
    marks = cases.select(*key, F.lit(None).cast("int").alias("signal"), F.lit(0).alias("_w"), F.lit(0).cast("long").alias("_bit"))
    bits = seen.select(*key, "signal", F.floor(away / _WORD).cast("int").alias("_w"), bit.alias("_bit")).unionByName(marks)
    words = range(far // _WORD + 1)

    def word(signal: int, w: int):
        here = (F.col("signal") == signal) & (F.col("_w") == w)
        return F.coalesce(F.bit_count(F.bit_or(F.when(here, F.col("_bit")))), F.lit(0))

    counts = bits.groupBy(*key).agg(*(word(s, w).alias(f"_{s}_{w}") for s in (PRIMARY, FALLBACK) for w in words))
    hb, polls = (sum((F.col(f"_{s}_{w}") for w in words), F.lit(0)) for s in (PRIMARY, FALLBACK))
    n = F.when(hb == 0, polls).otherwise(hb)
    return counts.select(*key, (F.lit(lookback) - n).cast("long").alias("days_with_no_heartbeat"))
