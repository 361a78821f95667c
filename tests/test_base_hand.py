"""Hand rows for O14, O15, O26, O29, O31, O32."""

import datetime as dt

from conftest import rows
from fleetcases.operators.base import installed_base, installed_base_totals, restrict_to_cohort
from fleetcases.operators.events import cohort_overlap, recently_seen_hosts
from fleetcases.operators.reports import reconcile_sku

D = dt.date
WRS, TAB = "Waiting Room Screen", "Exam Room Tablet"


def _base_inputs(spark):
    hist = spark.createDataFrame([
        (1, "AbC", 1, 10, WRS, "Installed", D(2020, 10, 9)),    # bound + 1 day: kept
        (1, "AbC", 1, 10, WRS, "Installed", D(2020, 10, 1)),    # daily copy: same asset
        (2, "B", 2, 20, WRS, "installed", D(2020, 10, 1)),      # status is exact-case here
        (3, "C", 1, 30, TAB, "Installed", D(2020, 10, 1)),      # other product
        (4, "D", 9, 40, WRS, "Installed", D(2020, 10, 1)),      # account without ranking
        (5, "E", 1, 50, WRS, "Installed", D(2020, 10, 10)),     # after the lowest bound + 1
        (6, "F", 1, 60, WRS, "Installed", D(2020, 9, 1)),       # no SKU match
    ], "ams_id long, asset_tag string, cmh_id long, source_system_id long, product string, "
       "status string, export_date date")
    accounts = spark.createDataFrame([(1, 3), (2, 1), (9, None)], "cmh_id long, ranking int")
    asset = spark.createDataFrame([("abc", 100), ("ABC", 100), ("b", 200)],
                                  "field_services_tag string, sku_id long")
    sku = spark.createDataFrame([(100, 0, "K1"), (200, 1, "K2")],
                                "id long, sku_type_id long, sku_code string")
    sku_type = spark.createDataFrame([(0, "LINUX_MEDIA_PLAYER"), (1, "ANDROID_MEDIA_PLAYER")],
                                     "id long, name string")
    return hist, accounts, asset, sku, sku_type


def test_installed_base_rules(spark):
    base = installed_base(*_base_inputs(spark), [D(2020, 12, 30), D(2020, 10, 8)])
    assert rows(base.distinct()) == [(1, "AbC", 10, "K1", "LINUX_MEDIA_PLAYER"),
                                     (6, "F", 60, None, None)]
    assert rows(installed_base_totals(base)) == [(2, 1, 0)]
    assert rows(installed_base_totals(base, ["sku_code"])) == [("K1", 1, 1, 0), (None, 1, 0, 0)]


def test_cohort_and_reconciled_sku(spark):
    base = installed_base(*_base_inputs(spark), [D(2020, 10, 8)])
    cases = spark.createDataFrame([("ABC", "LMP", "S-OLD", D(2020, 10, 1)),
                                   ("ABC", "LMP", "S-OLD", D(2020, 10, 5)),
                                   ("F", "AMP", "S-F", D(2020, 10, 2))],
                                  "asset_tag string, device_type string, sku string, start_date date")
    cohort = restrict_to_cohort(base, cases)     # upper(base tag) against the raw case tag
    assert rows(cohort.select("asset_tag").distinct()) == [("AbC",), ("F",)]
    # C2 joins on the raw tags: 'AbC' does not meet 'ABC'; F has no SKU code, keeps its own
    assert rows(reconcile_sku(cases, cohort)) == [("S-F", "AMP", 1, 1)]


def test_recently_seen_hosts(spark):
    hosts = spark.createDataFrame([(1, True, 2, 11), (2, False, 2, 12), (3, True, 0, 13),
                                   (4, True, 1, 14), (5, True, 1, 15), (6, None, 1, 11)],
                                  "id long, active boolean, nscreens int, config_profile_bag_id long")
    bags = spark.createDataFrame([(11, "Samsung LG 55"), (12, "LG"), (13, "LG"), (14, "Acme 40"),
                                  (15, "Phillips 32")], "id long, name string")
    t = dt.datetime(2024, 1, 10)
    polls = spark.createDataFrame([(1, t), (1, t), (2, t), (3, t), (4, t), (5, dt.datetime(2023, 1, 1)),
                                   (6, t)], "client_resource_id long, poll_last_utc timestamp_ntz")
    got = rows(recently_seen_hosts(hosts, bags, polls, dt.datetime(2024, 1, 2)))
    assert got == [(1, "LG"), (4, "Acme 40")]


def test_cohort_overlap_is_distinct(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "asset_id string")
    b = spark.createDataFrame([("x",), ("z",), (None,)], "asset_id string")
    assert rows(cohort_overlap(a, b, "asset_id")) == [("x",), (None,)]
