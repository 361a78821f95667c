"""Interval join by bins against pairs by brute force; rows moved; kept signal days joined where they lie."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows, srt
from fleetcases.operators.intervals import BIN, points_in_intervals, with_bin
from fleetcases.operators.signals import missing_signal_days, signal_days
from fleetcases.plans.context import context

D0 = dt.date(2020, 1, 1)


def _data(n=300, days=900, seed=1):
    rng = random.Random(seed)
    day = lambda: D0 + dt.timedelta(rng.randrange(days))
    starts = [(i, rng.choice(["a", "b", "hot", None]), day() if i % 11 else None) for i in range(n)]
    points = sorted({(rng.choice(["a", "b", "hot", "c"]), day()) for _ in range(3 * n)})
    return starts, points + [("a", None), (None, D0)]


@pytest.mark.parametrize("width", [1, 5, 365])
def test_points_in_intervals(spark, width):
    starts, points = _data()
    left = spark.createDataFrame(starts, "id long, k string, s date")
    right = spark.createDataFrame(points, "k string, day date").distinct()
    first, last = F.date_sub("s", width), F.date_sub("s", 1)
    want = srt((i, p) for i, k, s in starts for q, p in points
               if s and p and k and k == q and s - dt.timedelta(width) <= p < s)
    got = points_in_intervals(left, right, ["k"], first, last, "day", width)
    assert rows(got, "id", "day") == want
    assert rows(points_in_intervals(left, with_bin(right, "day", width), ["k"], first, last, "day", width, binned=True),
                "id", "day") == want
    # rows moved: at most two per interval, whatever the width
    bins = F.sequence(F.floor(F.unix_date(first) / width), F.floor(F.unix_date(last) / width))
    assert left.filter("s IS NOT NULL").select(F.max(F.size(bins))).first()[0] <= 2


@pytest.mark.parametrize("lookback", [5, 70, 365])
def test_missing_days_of_any_lookback(spark, lookback):
    """Windows within one word of bits, over several words, and wider than the kept bins."""
    rng = random.Random(lookback)
    first = dt.date(2020, 1, 10)
    cases = [(f"t{i % 7}", i % 9, D0 + dt.timedelta(rng.randrange(9, 500)), None, i, i % 5) for i in range(60)]
    at = lambda: dt.datetime.combine(D0, dt.time()) + dt.timedelta(days=rng.randrange(500), hours=rng.choice([0, 7]))
    beats, polls = [(rng.randrange(4), at()) for _ in range(600)], [(rng.randrange(9), at()) for _ in range(300)]
    key = ["asset_tag", "source_system_id", "start_date", "close_date", "case_duration"]
    df = spark.createDataFrame(cases, "asset_tag string, source_system_id long, start_date date, close_date date, "
                                      "case_duration long, client_id long")
    hb = spark.createDataFrame(beats, "client_id long, created_at timestamp_ntz")
    pl = spark.createDataFrame(polls, "client_resource_id long, poll_last_utc timestamp_ntz")
    want = {}
    for tag, source, start, close, n, client in cases:
        lo = dt.datetime.combine(start, dt.time()) - dt.timedelta(lookback + 1)
        hot = {t.date() for c, t in beats if c == client and lo < t < dt.datetime.combine(start, dt.time()) and t.date() >= first}
        cold = {t.date() for c, t in polls if c == source and start - dt.timedelta(lookback) <= t.date() < start
                and t.date() >= first - dt.timedelta(lookback + 1)}
        want[(tag, source, start, close, n)] = lookback - (len(hot) or len(cold))
    raw = missing_signal_days(df, hb, pl, first, lookback=lookback)
    kept = missing_signal_days(df, None, None, first, lookback=lookback, days=signal_days(hb, pl))
    for got in (raw, kept):
        assert {tuple(r[c] for c in key): r["days_with_no_heartbeat"] for r in got.collect()} == want


def test_kept_signal_days_are_joined_without_an_exchange(spark):
    c = context(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = missing_signal_days(c.case_table(), None, None, dt.date(2024, 1, 1), days=c.signal_days())
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scan = [i for i, line in enumerate(plan) if "fleetcases_signal_days" in line and "FileScan" in line]
    assert len(scan) == 1 and "Bucketed: true" in plan[scan[0]] and BIN in plan[scan[0]]
    join = max(i for i in range(scan[0]) if "SortMergeJoin" in plan[i])
    # the join's second input comes straight from the bucketed scan; only the cases are dealt out
    side = plan[join + 1:scan[0]]
    assert sum("Exchange" in line for line in side) == 1, "\n".join(plan)
    assert not any("Exchange" in line for line in side[-4:]), "\n".join(plan)


def test_signals_are_reduced_once_per_session(spark):
    c = context(spark, SF_SMALL)
    assert c.signal_days() is context(spark, SF_SMALL).signal_days()
    plan = c.build_case_table()._jdf.queryExecution().executedPlan().toString()
    assert "created_at" not in plan and "poll_last_utc" not in plan      # raw signals are not scanned again
