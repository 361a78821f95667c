"""Named queries, the case table, materialised tables, sinks and the oracle SQL."""

from fleetcases.plans.case_table import CASE_TABLE_COLUMNS, build_case_table
from fleetcases.plans.sinks import as_view, materialized, save_as_table, stage_table, write_table

__all__ = ["CASE_TABLE_COLUMNS", "build_case_table", "as_view", "materialized", "save_as_table",
           "stage_table", "write_table"]
