"""Null ordering (D8), ties (D18), calendar years (D9),
as-of bounds (D5), rule order (D21)."""

import datetime as dt


from conftest import rows
from fleetcases.functions.dates import as_of_filter, day_diff, year_diff
from fleetcases.functions.rules import classify_first_match
from fleetcases.operators.lookup import (device_age_years, earliest_known, join_ignore_case,
                                         latest_known)

D = dt.date


def test_latest_known_nulls_ties_and_exclusions(spark):
    h = spark.createDataFrame([
        ("a", "v1", D(2020, 1, 1)), ("a", "v2", D(2020, 2, 1)), ("a", "nil-3", D(2020, 3, 1)),
        ("b", "v1", D(2020, 1, 1)), ("b", "v9", D(2020, 1, 1)),   # tie -> greatest value
        ("c", "v1", D(2020, 5, 1)), ("c", "v0", None),            # null order counts as latest
        ("d", None, D(2020, 1, 1)),                               # only null values -> no row
    ], "asset_id string, device_apk_version string, export_date date")
    got = rows(latest_known(h, "asset_id", "device_apk_version", "export_date"))
    assert got == [("a", "v2"), ("b", "v9"), ("c", "v0")]


def test_latest_known_matches_row_number(spark):
    from conftest import SF_MID
    from fleetcases.sources.fixtures import Fixtures
    h = Fixtures(spark, SF_MID).devices_history
    h.createOrReplaceTempView("dh")
    want = spark.sql("""SELECT asset_id, device_apk_version FROM (
        SELECT asset_id, device_apk_version, row_number() OVER (PARTITION BY asset_id
          ORDER BY export_date DESC NULLS FIRST, device_apk_version DESC) rn
        FROM dh WHERE device_apk_version IS NOT NULL AND device_apk_version NOT LIKE '%nil%')
        WHERE rn = 1""")
    assert rows(latest_known(h, "asset_id", "device_apk_version", "export_date")) == rows(want)


def test_earliest_known(spark):
    h = spark.createDataFrame([("a", D(2020, 3, 1)), ("a", None), ("a", D(2020, 1, 5)),
                               ("b", None)], "k string, d date")
    assert rows(earliest_known(h, "k", "d")) == [("a", D(2020, 1, 5))]


def test_calendar_differences(spark):
    df = spark.createDataFrame([(dt.datetime(2019, 12, 31, 23), dt.datetime(2020, 1, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(day_diff("a", "b").alias("d"), year_diff("a", "b").alias("y")).first()
    assert (r.d, r.y) == (1, 1)


def test_device_age_uses_earlier_nullable_date(spark):
    df = spark.createDataFrame([(D(2019, 5, 1), D(2017, 1, 1)), (None, D(2018, 12, 31)),
                                (D(2020, 1, 1), None), (None, None)], "i date, d date")
    got = [r.age for r in df.select(device_age_years("i", "d", D(2020, 12, 30)).alias("age")).collect()]
    assert got == [3, 2, 0, None]


def test_as_of_filter_lowest_bound_and_pushdown(spark, tmp_path):
    p = str(tmp_path / "h")
    spark.createDataFrame([(D(1999, 10, 8),), (D(1999, 10, 9),), (D(1999, 10, 10),),
                           (D(2000, 12, 31),)], "export_date date").write.parquet(p)
    df = as_of_filter(spark.read.parquet(p), "export_date", [D(2000, 12, 30), D(1999, 10, 8)])
    assert rows(df) == [(D(1999, 10, 8),), (D(1999, 10, 9),)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(export_date,1999-10-09)" in plan


def test_join_ignore_case(spark):
    a = spark.createDataFrame([("AbC",), ("x",)], "tag string")
    b = spark.createDataFrame([("abc", 1)], "fst string, sku int")
    assert rows(join_ignore_case(a, b, "tag", "fst").select("tag", "sku")) == [("AbC", 1), ("x", None)]


def test_rule_order(spark):
    names = ["Samsung LG 55", "Phillips 40", "Philips 40", "Fransican A", "Sony Black 1",
             "Sony Silver 2", "ChiMei", "Polaroid", "Prima", "Acme 42", None, "lg lower"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.m for r in df.select(classify_first_match("name").alias("m")).collect()]
    assert got == ["LG", "Philips", "Philips", "Samsung", "Sony Black", "Sony Silver", "ChiMei",
                   "Polaroid", "Prima", "Acme 42", None, "lg lower"]
