"""Plan invariants that carry to full scale: no pair-producing joins, no Python in the hot
path, one shuffle for both case windows, signal windows pushed into the scans."""

import re

import pytest

from conftest import SF_SMALL
import __spark_entry__ as entry
from fleetcases.plans.queries import QUERIES
from fleetcases.operators.cases import build_cases
from fleetcases.operators.reports import closed_single_case_devices
from fleetcases.plans.case_table import build_case_table
from fleetcases.sources.fixtures import PARAMS, Fixtures

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairs_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert not [f for f in FORBIDDEN if f in plan], plan


def test_case_windows_share_one_shuffle(spark):
    log = Fixtures(spark, SF_SMALL).issue_log_dup      # not distinct: the dedupe is ours
    plan = _plan(build_cases(log, PARAMS.as_of))
    exchanges = re.findall(r"Exchange (\w+)\(([^)]*)\)", plan)
    # one exchange for the map-side distinct (all columns), one hashed on the device
    assert len(exchanges) == 2, plan
    assert sum(1 for kind, keys in exchanges if kind == "hashpartitioning"
               and keys.split(",")[0].startswith("asset_id")) >= 1
    # the distinct aggregates map-side before its shuffle
    assert re.search(r"HashAggregate\(keys=\[[^\]]*\], functions=\[\]\)\s*\n\s*\+- Exchange", plan) or \
        plan.count("HashAggregate") >= 2


def test_signal_windows_reach_the_scans(spark):
    fx = Fixtures(spark, SF_SMALL)
    ct = build_case_table(fx.issue_log, fx.assets, fx.accounts, fx.devices, fx.heartbeats,
                          fx.polls, PARAMS.as_of, staged=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan(ct)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan)
    assert any("GreaterThanOrEqual(ts," in p and "LessThan(ts," in p and "click" in p for p in pushed)
    assert any("GreaterThanOrEqual(ts," in p and "LessThan(ts," in p and "signup" in p for p in pushed)


def test_history_collapses_before_the_lookups(spark):
    from fleetcases.plans.context import context
    plan = _plan(context(spark, SF_SMALL).build_base())
    dedupe = re.findall(r"HashAggregate\(keys=\[ams_id#\d+L?, asset_tag#\d+, source_system_id#\d+L?, "
                        r"cmh_id#\d+L?\], functions=\[\]", plan)
    assert len(dedupe) == 2, plan          # partial (map side) and final
    assert "Exchange hashpartitioning(ams_id" in plan   # the shuffle between them


def test_signals_reduced_map_side(spark):
    fx = Fixtures(spark, SF_SMALL)
    ct = build_case_table(fx.issue_log, fx.assets, fx.accounts, fx.devices, fx.heartbeats,
                          fx.polls, PARAMS.as_of, staged=False)
    plan = _plan(ct)
    # heartbeats and polls each reduced to one row per (client, day), partial then final (the
    # poll side needs no last time, so Catalyst prunes it to a plain distinct)
    # (Spark extracts the to_date(ts) key into a projection as _groupingexpression)
    keys = re.findall(r"HashAggregate\(keys=\[entity#\d+L?, _groupingexpression#\d+\]", plan)
    assert len(keys) >= 4, plan
    assert "partial_max(ts" in plan
    assert "RangeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_accounts_are_broadcast(spark):
    fx = Fixtures(spark, SF_SMALL)
    ct = build_case_table(fx.issue_log_sparse, fx.assets, fx.accounts, fx.devices, fx.heartbeats,
                          fx.polls, PARAMS.as_of, staged=False)
    # what is sent whole to the driver and the tasks: regions, and accounts (made of nations and regions)
    keys = re.findall(r"BroadcastHashJoin \[([a-z_]+)#", _plan(ct))
    assert set(keys) <= {"cmh_id", "n_regionkey"}, keys
    cases = spark.createDataFrame([("A", "LMP", "2020-10-01", "2020-10-02"), ("B", "LMP", "2020-10-01", None)],
                                  "asset_tag string, device_type string, start_date string, close_date string")
    for form in ("join", "in"):
        got = closed_single_case_devices(cases, form)
        assert "BroadcastHashJoin" not in _plan(got) and [r.device_cnt for r in got.collect()] == [1]
