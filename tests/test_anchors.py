"""Values of FIXTURES.md §D (computed independently there) reproduced end to end."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_MID, SF_SMALL
from fleetcases.operators.cases import build_cases
from fleetcases.operators.events import attach_events, repeat_totals
from fleetcases.plans.context import context
from fleetcases.sources.fixtures import PARAMS

# values of cases and reboots: scripts/derive_anchors.py, plain Python over the raw rows
ANCHORS = {
    SF_SMALL: {"s04": {("ALL_CASES", 14, 14), ("AMP", 4, 4), ("LMP", 10, 10)}, "s22": 683,
               "s32_31": (9, 47), "o24_3": (10, 36), "s20": "2024-01-03 16:42:28.739617",
               "s16": (123, 37, 45), "s34": 4, "s28": 31, "s25": 15, "s33": 8, "s07": {("AMP", 15), ("LMP", 35)}},
    SF_MID: {"s04": {("ALL_CASES", 135, 135), ("AMP", 45, 45), ("LMP", 90, 90)}, "s22": 6135,
             "s22_sparse": 2210, "s32_31": (83, 395), "s32_sparse_3": (44, 56),
             "s32_sparse_31": (56, 89), "s33_sparse": 13, "o24_3": (99, 345),
             "s20": "2024-01-03 00:51:07.658581", "s16": (1200, 392, 451), "s34": 58, "s28": 31,
             "s25": 147, "s33": 66, "s17": 25, "s11_latest": 1496, "s07": {("AMP", 170), ("LMP", 321)}},
}


def _o24(c, horizon):
    cases = build_cases(c.log("full"), PARAMS.as_of).filter(F.col("device_type") == "LMP")
    tags = c.fx.devices.select(F.col("client_id").alias("asset_id"), F.col("asset_id").alias("asset_tag"))
    att = attach_events(cases.join(tags, "asset_id").select("asset_tag", "device_type", "start_date",
                                                             "close_date"),
                        c.fx.devices, c.fx.reboots, PARAMS.as_of)
    return tuple(repeat_totals(att, horizon).first())


@pytest.mark.slow
def test_anchors(spark):
    q = entry.queries()
    for sf, a in ANCHORS.items():
        c = context(spark, sf)
        assert {tuple(r) for r in q["devices_by_type_total"](spark, sf).collect()} == a["s04"]
        assert c.reboot_cases().count() == a["s22"]
        assert tuple(repeat_totals(c.reboot_cases(), 31).first()) == a["s32_31"]
        assert _o24(c, 3) == a["o24_3"]
        assert str(q["earliest_reboot"](spark, sf).first()[0]) == a["s20"]
        assert tuple(q["base_total"](spark, sf).first()) == a["s16"]
        assert q["host_tv"](spark, sf).count() == a["s34"]
        assert q["reboots_by_time"](spark, sf).count() == a["s28"]
        assert q["reboot_both_days"](spark, sf).count() == a["s25"]
        assert q["reboot_span_qc"](spark, sf).first()[0] == a["s33"]
        assert {(r.device_type, r.device_cnt) for r in q["single_closed_join"](spark, sf).collect()} == a["s07"]
        assert {(r.device_type, r.device_cnt) for r in q["single_closed_in"](spark, sf).collect()} == a["s07"]
        if sf == SF_MID:
            assert c.reboot_cases("sparse").count() == a["s22_sparse"]
            assert tuple(repeat_totals(c.reboot_cases("sparse"), 3).first()) == a["s32_sparse_3"]
            assert tuple(repeat_totals(c.reboot_cases("sparse"), 31).first()) == a["s32_sparse_31"]
            from fleetcases.operators.events import span_overlap_check
            assert span_overlap_check(c.reboot_cases("sparse")).first()[0] == a["s33_sparse"]
            assert q["base_by_sku"](spark, sf).count() == a["s17"]
            assert q["latest_version"](spark, sf).count() == a["s11_latest"]
