"""Reboot text parsing (D12), forward as-of match (O23, D26), repeat rule."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, rows
from fleetcases.operators.events import (attach_events, event_day, first_case_after_event,
                                         repeat_after_event, span_overlap_check)
from fleetcases.plans.context import context

D = dt.date


def test_event_day_blank_is_null(spark):
    df = spark.createDataFrame([("2020-11-12 21:34:45",), ("",), (None,), ("garbage",)], "t string")
    assert [r.d for r in df.select(event_day("t").alias("d")).collect()] == [D(2020, 11, 12), None, None, None]


ATT = "asset_tag string, start_date date, reboot_date date, days_btw_reboot_new_case long"


def _att(spark, data):
    return spark.createDataFrame(data, ATT)


def test_first_case_after_event_is_strict_and_earliest(spark):
    a = _att(spark, [("x", D(2020, 1, 5), D(2020, 1, 5), 0), ("x", D(2020, 1, 9), D(2020, 1, 5), 4),
                     ("x", D(2020, 1, 7), D(2020, 1, 5), 2), ("x", D(2020, 1, 1), D(2020, 1, 5), -4)])
    assert rows(first_case_after_event(a)) == [("x", D(2020, 1, 5), D(2020, 1, 7), 2)]


def test_repeat_rule_horizon(spark):
    a = _att(spark, [("one", D(2020, 2, 1), D(2020, 1, 1), 31),                       # 1 reboot day
                     ("two", D(2020, 1, 3), D(2020, 1, 1), 2), ("two", D(2020, 1, 30), D(2020, 1, 20), 10),
                     ("two", D(2020, 1, 3), D(2020, 1, 20), -17)])
    got = rows(repeat_after_event(a, horizon=5), "asset_tag", "reboot_date", "days_btw_reboot_new_case")
    assert got == [("one", D(2020, 1, 1), 31), ("two", D(2020, 1, 1), 2)]


def test_min_equals_row_number_on_fixture(spark):
    att = context(spark, SF_MID).reboot_cases()
    w = Window.partitionBy("asset_tag", "reboot_date").orderBy("start_date")
    by_window = (att.filter(F.col("days_btw_reboot_new_case") > 0)
                 .withColumn("rn", F.row_number().over(w)).filter("rn = 1")
                 .select("asset_tag", "reboot_date", "start_date", "days_btw_reboot_new_case"))
    assert rows(first_case_after_event(att)) == rows(by_window)


def test_attach_events_flag_and_gap(spark):
    cases = spark.createDataFrame([("T", "LMP", D(2020, 1, 10), None), ("T", "AMP", D(2020, 1, 10), None),
                                   ("U", "LMP", D(2020, 1, 10), D(2020, 1, 12))],
                                  "asset_tag string, device_type string, start_date date, close_date date")
    dev = spark.createDataFrame([("T", 1), ("U", 2)], "asset_id string, client_id long")
    rb = spark.createDataFrame([(1, "2020-01-12 08:00:00"), (2, "2020-01-13 08:00:00"), (2, "")],
                               "client_id long, reboot_time string")
    got = rows(attach_events(cases, dev, rb, D(2020, 1, 20)).select(
        "asset_tag", "reboot_date", "reboot_flag", "days_btw_reboot_new_case"))
    assert got == [("T", D(2020, 1, 12), 1, -2), ("U", D(2020, 1, 13), 0, -3), ("U", None, 0, None)]


def test_span_overlap(spark):
    a = _att(spark, [("x", D(2020, 1, 1), D(2020, 1, 3), 0), ("x", D(2020, 1, 9), None, 0),
                     ("y", D(2020, 1, 1), D(2020, 2, 1), 0), (None, D(2020, 1, 1), D(2020, 1, 1), 0)])
    assert span_overlap_check(a).first().device_cnt == 1
