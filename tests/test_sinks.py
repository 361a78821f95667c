"""Sinks: overwrite table (S01/S02, S21/S22) by path and by catalog name, view."""

from conftest import SF_SMALL, rows
from fleetcases.plans.queries import QUERIES
from fleetcases.plans.sinks import as_view, save_as_table, write_table


def test_table_sinks_overwrite(spark, tmp_path):
    df = QUERIES["cases_by_type_total"](spark, SF_SMALL)
    want = rows(df)
    path = str(tmp_path / "t")
    assert rows(write_table(df, path)) == want
    assert rows(write_table(df, path)) == want            # second write replaces, no append
    spark.sql(f"CREATE DATABASE IF NOT EXISTS fc_test LOCATION '{tmp_path / 'db'}'")
    assert rows(save_as_table(df, "fc_test.case_report")) == want
    assert rows(save_as_table(df, "fc_test.case_report")) == want
    spark.sql("DROP DATABASE fc_test CASCADE")


def test_view_sink(spark):
    df = QUERIES["device_total_by_type"](spark, SF_SMALL)
    as_view(df, "fc_devices_by_type")
    assert rows(spark.table("fc_devices_by_type")) == rows(df)
    spark.catalog.dropTempView("fc_devices_by_type")


def test_concurrent_queries_build_tables_once(spark):
    from concurrent.futures import ThreadPoolExecutor
    names = ["cases_by_type_total", "devices_by_type_total", "case_frequency", "cases_by_sku"]
    sf = "/root/testdata/sf0.01"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: rows(QUERIES[n](spark, sf)), names))
    assert got == [rows(QUERIES[n](spark, sf)) for n in names]


def test_views_over_the_created_tables(spark):
    from fleetcases.plans.context import context
    names = context(spark, SF_SMALL).register_views(prefix="fc_")
    assert "fc_case_table" in names
    by_sql = spark.sql("""
        SELECT device_type, count(*) AS total_cases,
               CAST(sum(CASE WHEN days_with_no_heartbeat > 0 THEN 1 ELSE 0 END) AS BIGINT) AS heartbeat_missing
        FROM fc_case_table GROUP BY device_type
        UNION
        SELECT 'ALL_CASES', count(*), CAST(sum(CASE WHEN days_with_no_heartbeat > 0 THEN 1 ELSE 0 END) AS BIGINT)
        FROM fc_case_table""")
    assert rows(by_sql) == rows(QUERIES["cases_by_type_total"](spark, SF_SMALL))
    for n in names:
        spark.catalog.dropTempView(n)


def test_partitioned_layout_prunes(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from fleetcases.plans.context import context
    hist = context(spark, SF_SMALL).fx.devices_history
    back = write_table(hist, str(tmp_path / "dh"), partition_by="export_date")
    assert back.count() == hist.count()
    q = back.filter(F.col("export_date") <= F.lit(dt.date(1995, 6, 30)))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(export_date" in plan
    assert q.count() == hist.filter(F.col("export_date") <= F.lit(dt.date(1995, 6, 30))).count()
