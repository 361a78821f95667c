"""Merged timeline, cohort masks, two-step arg-max and one-scan totals against other forms of the same."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows, srt
from fleetcases.operators.events import (attach_events, cohort_masks, cohort_overlap, first_case_after_event, histogram_of,
                                         in_all, next_case_after, repeat_after_event, repeat_cases, repeat_histogram,
                                         repeat_totals, totals_of)
from fleetcases.operators.lookup import latest_known
from fleetcases.operators.reports import devices_and_missing
from fleetcases.plans.context import context

D0 = dt.date(2020, 10, 1)
AS_OF = D0 + dt.timedelta(60)


def _inputs(spark, seed):
    rng = random.Random(seed)
    day = lambda: D0 + dt.timedelta(rng.randrange(25))
    tags = ["a", "b", "c", "spare", None]
    cases = [(rng.choice(tags), rng.choice(["LMP", "LMP", "AMP"]), day(), None) for _ in range(40)]
    devices = [("a", 1), ("a", 2), ("b", 2), ("c", 3), ("c", 3), ("gone", 4), (None, 5), ("b", None)]
    reboots = [("x", rng.choice([1, 2, 3, 4, 5, None]), rng.choice([f"{day()} 12:00:00"] * 5 + ["", "junk", None]))
               for _ in range(30)]
    return (spark.createDataFrame(cases, "asset_tag string, device_type string, start_date date, close_date date"),
            spark.createDataFrame(devices, "asset_id string, client_id long"),
            spark.createDataFrame(reboots, "asset_id string, client_id long, reboot_time string"))


@pytest.mark.parametrize("seed", range(4))
def test_timeline_equals_the_pairs(spark, seed):
    cases, devices, reboots = _inputs(spark, seed)
    attached = attach_events(
        cases, devices, reboots, AS_OF)
    cols = ["asset_tag", "reboot_date", "start_date", "days_btw_reboot_new_case"]
    pairs = first_case_after_event(attached).filter("asset_tag IS NOT NULL")
    assert rows(next_case_after(cases, devices, reboots), *cols) == rows(pairs, *cols)
    for horizon in (1, 4, 31):
        new = repeat_cases(cases, devices, reboots, horizon)
        assert rows(new, *cols, "reboots") == rows(repeat_after_event(attached, horizon), *cols, "reboots")
        assert rows(histogram_of(new)) == rows(repeat_histogram(attached, horizon))
        assert rows(totals_of(new)) == rows(repeat_totals(attached, horizon))


def test_timeline_makes_no_pairs(spark):
    c = context(spark, SF_SMALL)
    plan = repeat_cases(c.case_table(), c.fx.devices, c.fx.reboots, 3)._jdf.queryExecution().executedPlan().toString()
    assert "reboot_flag" not in plan and plan.count("Window") >= 1
    hot_case = [("a", "LMP", D0 + dt.timedelta(i), None) for i in range(400)]
    hot_reboot = [("a", 1, f"{D0 + dt.timedelta(i)} 01:00:00") for i in range(400) for _ in range(5)]
    cases = spark.createDataFrame(hot_case, "asset_tag string, device_type string, start_date date, close_date date")
    reboots = spark.createDataFrame(hot_reboot, "asset_id string, client_id long, reboot_time string")
    got = next_case_after(cases, spark.createDataFrame([("a", 1)], "asset_id string, client_id long"), reboots)
    assert got.count() == 399 and got.agg(F.max("days_btw_reboot_new_case")).first()[0] == 1


def test_masks_are_intersections(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", "c", None]), rng.randrange(6), rng.choice([True, False, None])) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, n int, flag boolean")
    conds = [F.col("n") < 2, F.col("flag"), F.col("n") > 3]
    want = df.filter(conds[0]).select("k").intersect(df.filter(conds[1]).select("k")).intersect(df.filter(conds[2]).select("k"))
    assert rows(in_all(cohort_masks(df, "k", conds), 3)) == rows(want)
    a, b = df.filter("n = 1").select("k"), df.filter("n = 5").select("k")
    assert rows(cohort_overlap(a, b, "k")) == rows(a.intersect(b))
    plan = in_all(cohort_masks(context(spark, SF_SMALL).fx.reboots, "asset_id", conds[:0] + [
        F.col("reboot_time").like("2024-01-1%"), F.col("reboot_time").like("2024-01-2%")]), 2)
    assert plan._jdf.queryExecution().executedPlan().toString().count("events.parquet") == 1


def test_latest_known_equals_sorting(spark):
    rng = random.Random(9)
    data = [(rng.choice(["a", "b", "c", None]), rng.choice(["1", "2", "nil", "10", None]),
             None if rng.random() < 0.1 else D0 + dt.timedelta(rng.randrange(5))) for _ in range(80)]
    # two values of unknown order, the lesser with the later known one
    data += [("tie", "1", None), ("tie", "1", D0 + dt.timedelta(4)), ("tie", "2", None), ("tie", "2", D0)]
    df = spark.createDataFrame(data, "k string, v string, d date")
    want = {}
    for k, v, d in data:
        if v is not None and "nil" not in v:
            rank = (d is None, d or D0, v)
            if k not in want or rank > want[k][0]:
                want[k] = (rank, v)
    got = latest_known(df, "k", "v", "d")
    assert rows(got) == srt((k, v) for k, (_, v) in want.items())
    plan = context(spark, SF_SMALL).build_latest_version()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_device_totals_of_odd_tables(spark):
    schema = "device_type string, asset_tag string, days_with_no_heartbeat long"
    df = spark.createDataFrame([("LMP", "a", 1), ("AMP", "a", 0), (None, "b", None), ("LMP", None, 3), ("ALL_CASES", "c", 2)], schema)
    assert rows(devices_and_missing(df)) == srt([("LMP", 1, 1), ("AMP", 1, 0), (None, 1, 0), ("ALL_CASES", 1, 1), ("ALL_CASES", 3, 2)])
    assert rows(devices_and_missing(spark.createDataFrame([], schema))) == [("ALL_CASES", 0, 0)]
    plan = devices_and_missing(context(spark, SF_SMALL).case_table())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
