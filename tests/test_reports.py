"""O7-O10, O13, O15 and the identities of SURVEY §5.2."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF_MID, rows
import __spark_entry__ as entry
from fleetcases.operators.base import installed_base_totals
from fleetcases.operators.reports import (breakdown_with_total, case_breakdown,
                                          closed_single_case_in, closed_single_case_join,
                                          frequency_of_counts)

D = dt.date
CT = "asset_tag string, device_type string, start_date date, close_date date, days long"


def test_total_row_keeps_null_group(spark):
    df = spark.createDataFrame([("a", "LMP", D(2020, 1, 1), None, 1), ("b", None, D(2020, 1, 2), None, 0),
                                ("c", None, D(2020, 1, 3), None, 2)], CT)
    got = rows(breakdown_with_total(df, "device_type", {"n": F.count(F.lit(1)),
                                                       "m": F.sum((F.col("days") > 0).cast("int"))}))
    assert got == [("ALL_CASES", 3, 2), ("LMP", 1, 1), (None, 2, 1)]


def test_case_breakdown_counts(spark):
    df = spark.createDataFrame([("a", "L", D(2020, 1, 1), None, 0), ("a", "L", D(2020, 1, 1), None, 0),
                                ("a", "L", D(2020, 1, 5), None, 0), (None, "L", D(2020, 1, 1), None, 0),
                                ("b", "L", None, None, 0)], CT)
    assert rows(case_breakdown(df, ["device_type"])) == [("L", 2, 5)]
    # distinct (device, start) pairs skip pairs with a null part
    got = rows(case_breakdown(df, ["device_type"], case_count="distinct"))
    assert got == [("L", 2, 2)]


def test_frequency_and_single_closed(spark):
    df = spark.createDataFrame([("a", "L", D(2020, 1, 1), D(2020, 1, 2), 0),
                                ("b", "L", D(2020, 1, 1), None, 0), ("b", "L", D(2020, 1, 9), D(2020, 1, 9), 0),
                                ("c", "A", D(2020, 1, 3), None, 0)], CT)
    assert rows(frequency_of_counts(df)) == [(1, 2), (2, 1)]
    assert rows(closed_single_case_join(df)) == [(1, "L", 1)]
    assert rows(closed_single_case_in(df)) == [("L", 1)]


def test_installed_base_totals_brute_force(spark):
    data = [(1, "S1", "LINUX_MEDIA_PLAYER"), (1, "S1", "ANDROID_MEDIA_PLAYER"), (2, "S1", None),
            (3, "S2", "LINUX_MEDIA_PLAYER"), (None, "S2", "LINUX_MEDIA_PLAYER"), (3, "S2", "TABLET")]
    df = spark.createDataFrame(data, "ams_id long, sku_code string, name string")
    got = rows(installed_base_totals(df, ["sku_code"]))
    want = []
    for sku in ("S1", "S2"):
        ids = {a for a, s, _ in data if s == sku and a is not None}
        lmp = {a for a, s, n in data if s == sku and a is not None and n == "LINUX_MEDIA_PLAYER"}
        amp = {a for a, s, n in data if s == sku and a is not None and n == "ANDROID_MEDIA_PLAYER"}
        want.append((sku, len(ids), len(lmp), len(amp)))
    assert got == want


def _q(spark, name, sf=SF_MID):
    return entry.queries()[name](spark, sf)


def test_identities_on_fixture(spark):
    # S07 = S08 (one device type per device on the fixture)
    j = {(r.device_type, r.device_cnt) for r in _q(spark, "single_closed_join").collect()}
    i = {(r.device_type, r.device_cnt) for r in _q(spark, "single_closed_in").collect()}
    assert j == i and j == {("AMP", 170), ("LMP", 321)}
    # S03 total row = sum of its groups
    s03 = {r.device_type: (r.total_cases, r.heartbeat_missing)
           for r in _q(spark, "cases_by_type_total").collect()}
    total = s03.pop("ALL_CASES")
    assert total == tuple(map(sum, zip(*s03.values()))) == (957, 814)
    # S14 = sum of S15; S05 summed = S06 summed
    s14 = _q(spark, "device_total").first().device_cnt
    assert s14 == sum(r.device_cnt for r in _q(spark, "device_total_by_type").collect()) == 135
    assert (sum(r.device_cnt for r in _q(spark, "case_frequency").collect())
            == sum(r.device_cnt for r in _q(spark, "case_frequency_by_type").collect()))


def test_anchor_totals(spark):
    assert tuple(_q(spark, "base_total").first()) == (1200, 392, 451)
    assert tuple(_q(spark, "repeat_after_reboot").first()) == (82, 283)
    assert _q(spark, "reboot_span_qc").first().device_cnt == 66
    assert _q(spark, "reboot_cases").count() == 6135


def test_devices_and_missing_counts_a_device_once_in_the_total(spark):
    from fleetcases.operators.reports import devices_and_missing
    df = spark.createDataFrame([("a", "LMP", D(2020, 1, 1), None, 1), ("a", "AMP", D(2020, 1, 2), None, 0),
                                ("b", None, D(2020, 1, 3), None, 0), (None, "LMP", D(2020, 1, 4), None, 3)], CT)
    got = rows(devices_and_missing(df, gap="days"))
    assert got == [("ALL_CASES", 2, 1), ("AMP", 1, 0), ("LMP", 1, 1), (None, 1, 0)]


def test_conditional_counts(spark):
    from fleetcases.functions.rules import conditional_count, conditional_count_distinct
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), (None, 5), ("c", None)], "k string, v int")
    r = df.agg(conditional_count(F.col("v") > 0).alias("n"),
               conditional_count_distinct("k", F.col("v") > 0).alias("d")).first()
    assert (r.n, r.d) == (3, 1)


def test_report_order_follows_the_statement(spark):
    got = [(r.clinic_ranking, r.device_type) for r in _q(spark, "cases_by_ranking").collect()]
    # ORDER BY 1 DESC, 2: nulls first on the descending key (D8), then ranking 4..0, type asc
    assert got[0][0] is None
    ranks = [g[0] for g in got if g[0] is not None]
    assert ranks == sorted(ranks, reverse=True)
    assert got == sorted(got, key=lambda t: (t[0] is not None, -(t[0] or 0), t[1]))
    freq = [r.case_cnt for r in _q(spark, "case_frequency").collect()]
    assert freq == sorted(freq)


def test_closed_single_case_devices_forms(spark):
    from fleetcases.operators.reports import closed_single_case_devices
    ct = _q(spark, "case_table_sparse")
    assert rows(closed_single_case_devices(ct, "join")) == rows(_q(spark, "single_closed_join"))
    assert rows(closed_single_case_devices(ct, "in")) == rows(_q(spark, "single_closed_in"))


def test_optional_share_column(spark):
    from fleetcases.operators.reports import cases_and_missing, devices_and_missing
    ct = _q(spark, "case_table")
    s03 = {r.device_type: r.pct_missing for r in cases_and_missing(ct, with_share=True).collect()}
    assert s03["ALL_CASES"] == round(814 * 100.0 / 957, 3)
    assert "pct_missing" not in _q(spark, "cases_by_type_total").columns
    s04 = {r.device_type: r.pct_missing for r in devices_and_missing(ct, with_share=True).collect()}
    assert s04["ALL_CASES"] == 100.0
