"""Inputs: base parquet tables and the fixture views that stand in for the warehouse tables."""

from fleetcases.sources.extracts import read_reboot_extract, read_tv_extract
from fleetcases.sources.fixtures import PARAMS, FixtureParams, Fixtures
from fleetcases.sources.tables import BASE_TABLES, read_table

__all__ = ["PARAMS", "FixtureParams", "Fixtures", "BASE_TABLES", "read_table",
           "read_reboot_extract", "read_tv_extract"]
