"""The fixture views have the row counts FIXTURES.md §B lists for sf0.01."""

import pytest

from conftest import SF_MID
from fleetcases.plans.context import context

EXPECTED = {
    "issue_log": 1612, "issue_log_dup": 2014, "issue_log_sparse": 1972, "assets": 1500,
    "accounts": 25, "devices": 1500, "heartbeats": 3988, "polls": 2017,
    "devices_history": 15000, "assets_history": 15000, "asset": 1500, "sku": 2000,
    "sku_type": 5, "app_devices": 1500, "activities": 10000, "taggings": 3998, "tags": 5,
    "reboots": 1981, "host": 100, "bag": 2000, "monitor_poll": 10000,
}


@pytest.mark.parametrize("view", sorted(EXPECTED))
def test_view_rows(spark, view):
    assert getattr(context(spark, SF_MID).fx, view).count() == EXPECTED[view]


def test_tv_extract_rows(spark):
    assert context(spark, SF_MID).tv().count() == 58


def test_accounts_have_one_null_ranking(spark):
    acc = context(spark, SF_MID).fx.accounts
    assert acc.filter("ranking IS NULL").count() == 1
    assert acc.filter("billing_street IS NULL").count() == 25


def test_oracle_fixture_ctes_have_the_same_rows():
    import duckdb

    from fleetcases.plans.oracle import CTES
    from fleetcases.sources.tables import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    for view, n in EXPECTED.items():
        name = "fx_" + view
        deps = ",\n".join(f"{k} AS ({CTES[k]})" for k in CTES if k.startswith("fx_"))
        got = con.execute(f"WITH {deps} SELECT count(*) FROM {name}").fetchall()[0][0]
        assert got == n, name
