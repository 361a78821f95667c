"""O6 on hand rows: D19 (one tag, two clients), D6 (status case), D10 (duration to as_of)."""

import datetime as dt

from conftest import rows
from fleetcases.plans.case_table import build_case_table

D = lambda d: dt.date(2020, 10, d)
T = lambda d, h=12: dt.datetime(2020, 10, d, h)
AS_OF = D(20)


def _inputs(spark):
    log = spark.createDataFrame(
        [(1, 11, 1, 101, "LMP", D(d)) for d in (8, 15, 16)] + [(2, 12, 1, 102, "AMP", D(18))]
        + [(3, 13, 2, 103, "LMP", D(19))],
        "ams_id long, asset_id long, cmh_id long, source_system_id long, device_type string, date date")
    assets = spark.createDataFrame([(1, "TAG1", "S1", "installed"), (2, None, "S2", "INSTALLED"),
                                    (3, "TAG3", "S3", "Retired")],
                                   "ams_id long, asset_tag string, sku string, status string")
    accounts = spark.createDataFrame([(1, "Acme", 2, None, "Town", "ST")],
                                     "cmh_id long, account_name string, ranking int, billing_street string, "
                                     "billing_city string, billing_state_province string")
    devices = spark.createDataFrame([("TAG1", 7, "v1"), ("TAG1", 8, "v2")],
                                    "asset_id string, client_id long, device_apk_version string")
    hb = spark.createDataFrame([(7, T(10)), (8, T(12)), (8, T(13)), (7, T(13))],
                               "client_id long, created_at timestamp_ntz")
    polls = spark.createDataFrame([(102, T(15))], "client_resource_id long, poll_last_utc timestamp_ntz")
    return log, assets, accounts, devices, hb, polls


def test_two_clients_share_the_gap_and_multiply_rows(spark):
    ct = build_case_table(*_inputs(spark), AS_OF, staged=False)
    got = rows(ct, "asset_tag", "start_date", "close_date", "case_duration", "client_id",
               "software_version", "clinic_ranking", "days_with_no_heartbeat")
    # TAG1: cases 8-8 and 15-16; heartbeat days 10, 12, 13 from both clients pooled -> 5 - 3
    # for the 15th (window 9th after midnight .. 14th); the 8th has none before it -> 5
    assert got == [
        ("TAG1", D(8), D(8), 1, 7, "v1", 2, 5), ("TAG1", D(8), D(8), 1, 8, "v2", 2, 5),
        ("TAG1", D(15), D(16), 2, 7, "v1", 2, 2), ("TAG1", D(15), D(16), 2, 8, "v2", 2, 2),
        # null tag: kept (closed single day: 18 is not as_of), no device, and a null gap since
        # the gap join on the tag misses; ams 3 is retired, so its case is gone
        (None, D(18), D(18), 1, None, None, 2, None),
    ]


def test_empty_log_gives_empty_table(spark):
    log, assets, accounts, devices, hb, polls = _inputs(spark)
    ct = build_case_table(log.limit(0), assets, accounts, devices, hb, polls, AS_OF, staged=False)
    assert ct.count() == 0 and "days_with_no_heartbeat" in ct.columns


def test_known_day_span_gives_same_table(spark):
    args = _inputs(spark)
    a = build_case_table(*args, AS_OF, staged=False)
    b = build_case_table(*args, AS_OF, staged=False, first_day=D(8), last_day=D(19))
    assert rows(a) == rows(b)


def test_two_assets_one_tag_multiply_on_the_gap_join(spark):
    from fleetcases.operators.reports import duplicate_keys
    log = spark.createDataFrame([(1, 11, 1, 101, "LMP", D(10)), (2, 12, 1, 102, "LMP", D(10))],
                                "ams_id long, asset_id long, cmh_id long, source_system_id long, "
                                "device_type string, date date")
    assets = spark.createDataFrame([(1, "T", "S1", "Installed"), (2, "T", "S2", "Installed")],
                                   "ams_id long, asset_tag string, sku string, status string")
    _, _, accounts, _, _, _ = _inputs(spark)
    devices = spark.createDataFrame([], "asset_id string, client_id long, device_apk_version string")
    hb = spark.createDataFrame([], "client_id long, created_at timestamp_ntz")
    polls = spark.createDataFrame([(101, T(7)), (101, T(8))],
                                  "client_resource_id long, poll_last_utc timestamp_ntz")
    ct = build_case_table(log, assets, accounts, devices, hb, polls, AS_OF, staged=False,
                          first_day=D(1), last_day=D(10))
    # two gap groups for (T, 10th): source 101 saw polls on 2 days (gap 3), 102 none (gap 5);
    # each of the two case rows takes both
    assert rows(ct, "ams_id", "sku", "days_with_no_heartbeat") == [
        (1, "S1", 3), (1, "S1", 5), (2, "S2", 3), (2, "S2", 5)]
    assert rows(duplicate_keys(ct, ["asset_tag", "start_date"])) == [("T", D(10), 4)]
