"""S41 as a live catalog view: a day appended to the log is in the next answer; as_of is its parameter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from fleetcases.plans.case_table import CASE_TABLE_COLUMNS, build_case_table
from fleetcases.plans.context import context
from fleetcases.plans.views import INPUTS, case_view_sql, create_case_view, set_as_of
from fleetcases.sources.fixtures import PARAMS

CUT = dt.date(2024, 1, 20)


@pytest.fixture
def tables(spark, tmp_path):
    """The fixture's inputs as catalog tables, the log up to CUT."""
    fx = context(spark, SF_SMALL).fx
    frames = dict(zip(INPUTS, (fx.issue_log.filter(F.col("date") <= CUT), fx.assets, fx.accounts, fx.devices,
                               fx.heartbeats, fx.polls), strict=True))
    spark.sql(f"CREATE DATABASE fc_view LOCATION '{tmp_path / 'db'}'")
    for name, df in frames.items():
        df.write.saveAsTable(f"fc_view.{name}")
    yield {n: f"fc_view.{n}" for n in frames}
    spark.sql("DROP DATABASE fc_view CASCADE")


def _built(spark, tables, as_of):
    t = spark.table
    return rows(build_case_table(*(t(tables[n]) for n in INPUTS), as_of, legacy=True, staged=False))


def test_view_shows_a_day_that_is_appended(spark, tables):
    view = create_case_view(spark, "fc_view.case_view", tables, as_of=PARAMS.as_of)
    assert view.columns == list(CASE_TABLE_COLUMNS)
    before = rows(spark.table("fc_view.case_view"))
    assert before == _built(spark, tables, PARAMS.as_of)
    fx = context(spark, SF_SMALL).fx
    more = fx.issue_log.filter((F.col("date") > CUT) & (F.col("date") <= CUT + dt.timedelta(1)))
    assert more.count() > 0
    more.write.insertInto("fc_view.log")
    after = rows(spark.table("fc_view.case_view"))
    assert after != before and after == _built(spark, tables, PARAMS.as_of)
    # files put into the folder by another writer, not through the catalog
    rest = fx.issue_log.filter(F.col("date") > CUT + dt.timedelta(1))
    place = spark.sql("DESCRIBE TABLE EXTENDED fc_view.log").filter("col_name = 'Location'").first()["data_type"]
    rest.write.mode("append").parquet(place)
    spark.catalog.refreshTable("fc_view.log")
    assert rows(spark.table("fc_view.case_view")) == _built(spark, tables, PARAMS.as_of)


def test_as_of_is_the_views_parameter(spark, tables):
    create_case_view(spark, "fc_live_cases", tables, as_of=CUT, temporary=True, variable=True)
    at_cut = rows(spark.table("fc_live_cases"))
    assert at_cut == _built(spark, tables, CUT)
    set_as_of(spark, CUT + dt.timedelta(5))
    later = rows(spark.table("fc_live_cases"))
    assert later == _built(spark, tables, CUT + dt.timedelta(5)) and later != at_cut
    create_case_view(spark, "fc_view.today", tables)          # the clock, as the source's getdate()
    assert rows(spark.table("fc_view.today")) == _built(spark, tables, dt.datetime.now(dt.UTC).date())
    spark.catalog.dropTempView("fc_live_cases")


def test_create_replaces(spark, tables):
    create_case_view(spark, "fc_view.v", tables, as_of=CUT)
    create_case_view(spark, "fc_view.v", tables, as_of=CUT + dt.timedelta(5))
    assert rows(spark.table("fc_view.v")) == _built(spark, tables, CUT + dt.timedelta(5))


def test_unknown_devices_and_wide_lookback(spark):
    from test_cases_hot_key import AS_OF, _log
    log = _log(spark, n=800)
    fx = context(spark, SF_SMALL).fx
    frames = dict(zip(INPUTS, (log, fx.assets, fx.accounts, fx.devices, fx.heartbeats, fx.polls), strict=True))
    for n, df in frames.items():
        df.createOrReplaceTempView(f"fc_in_{n}")
    view = create_case_view(spark, "fc_wide", {n: f"fc_in_{n}" for n in frames}, AS_OF, temporary=True, lookback=40)
    assert rows(view) == rows(build_case_table(*frames.values(), AS_OF, legacy=True, lookback=40))
    with pytest.raises(ValueError):
        case_view_sql({n: n for n in INPUTS}, lookback=62)


def test_view_plan(spark):
    plan = context(spark, SF_SMALL).case_view()._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in plan
