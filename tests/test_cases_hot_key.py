"""Cases where a third of the log has no device: spans stitched to the same rows, no task with a heap."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetcases.operators.cases import (CASE_ATTRS, _days_of, _variants, build_cases, build_cases_legacy,
                                        flag_case_boundaries)

AS_OF = dt.date(2021, 3, 1)
SCHEMA = "ams_id long, asset_id string, cmh_id long, source_system_id long, device_type string, date date"


def _log(spark, n=6000, devices=200, days=120, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = None if rng.random() < 0.34 else f"d{rng.randrange(devices)}"
        out.append((rng.randrange(50), k, rng.randrange(9), 1, rng.choice(["LMP", "AMP"]),
                    AS_OF - dt.timedelta(rng.randrange(days))))
    out += [(1, "placeholder", 1, 1, "LMP", AS_OF - dt.timedelta(i)) for i in range(days)]
    return spark.createDataFrame(out + [(1, None, 1, 1, None, None)], SCHEMA)


@pytest.mark.parametrize("span_days", [1, 7, 32, 400])
def test_spans_give_the_same_cases(spark, span_days):
    log = _log(spark)
    for builder in (build_cases, build_cases_legacy):
        for dedupe in (True, False):
            assert rows(builder(log, AS_OF, dedupe=dedupe, span_days=span_days)) == rows(builder(log, AS_OF, dedupe=dedupe))
    cols = ["asset_id", "date", "ams_id", "cmh_id", "device_type", "opens", "closes", "rn"]
    distinct = log.distinct()
    assert rows(flag_case_boundaries(distinct, AS_OF, span_days=span_days), *cols) == rows(
        flag_case_boundaries(distinct, AS_OF), *cols)


def test_case_table_takes_spans_by_itself(spark):
    """The aggregate that finds the log's first day also sees that devices are missing."""
    from fleetcases.functions.dates import log_span
    log = _log(spark)
    assert log_span(log, "date", "asset_id")[2] is True
    assert log_span(log.filter("asset_id IS NOT NULL"), "date", "asset_id")[2] is False


def test_no_task_holds_the_unknown_device(spark):
    log = _log(spark, n=40_000, devices=4000, days=400)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    rest = [c for c in CASE_ATTRS if c != "asset_id"]

    def sizes(df):
        per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        counts = sorted(r["count"] for r in per)
        return counts[-1], counts[len(counts) // 2]

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        variants = _variants(log, "asset_id", "date", rest)
        most, median = sizes(variants)
        assert most <= 2 * median
        by_day = variants.repartition("asset_id", "date")       # as the aggregate per (device, day) deals them
        most, median = sizes(by_day)
        assert most <= 2 * median
        assert sizes(variants.repartition("asset_id"))[0] > 4 * median      # what gathering by device would do
        # what reaches the window per device is one row per day
        days = _days_of(variants, ["asset_id", "date"], rest, True)
        assert days.filter("asset_id IS NULL").count() <= 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_sort_below_the_first_exchange(spark):
    log = _log(spark, n=50)
    for builder in (build_cases, build_cases_legacy):
        plan = builder(log, AS_OF, first_day=AS_OF)._jdf.queryExecution().executedPlan().toString()
        last = plan.rindex("Exchange hashpartitioning")       # the plan is printed from the result down
        assert "Sort" not in plan[last:] and "HashAggregate" in plan[last:], plan
        assert plan.count("Sort [") == 1, plan                 # one sort serves the aggregate per day and both windows
