"""fleetcases: device-fleet case analytics on Spark DataFrames.

Layout
------
sources/    base tables and the fixture views that stand in for the warehouse tables
functions/  column-level helpers (date arithmetic, rule tables, conditional counts)
operators/  DataFrame -> DataFrame operators (cases, signals, lookups, reports, base, events)
plans/      named queries built from the operators, the materialised tables, oracle SQL
"""

from fleetcases.session import get_session, work_dir

__all__ = ["get_session", "work_dir"]
