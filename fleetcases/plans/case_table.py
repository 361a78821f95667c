"""The case table (O6, S02) and its older view variant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.constants import CASE_SPAN_DAYS, LOOKBACK_DAYS
from fleetcases.functions.dates import log_span
from fleetcases.operators.cases import ENRICHED_COLUMNS, build_cases, build_cases_legacy, enrich_cases
from fleetcases.operators.signals import missing_signal_days
from fleetcases.plans.sinks import stage_table

CASE_TABLE_COLUMNS = (*ENRICHED_COLUMNS, "days_with_no_heartbeat")


def build_case_table(log: DataFrame, assets: DataFrame, accounts: DataFrame, devices: DataFrame,
                     heartbeats: DataFrame | None, polls: DataFrame | None, as_of: dt.date, *,
                     legacy: bool = False, dedupe: bool = True, lookback: int = LOOKBACK_DAYS,
                     strict_days: bool = False, day: str = "date",
                     staged: bool = True, first_day: dt.date | None = None,
                     last_day: dt.date | None = None, span_days: int | None = None,
                     days: DataFrame | None = None) -> DataFrame:
    """Cases -> enriched cases -> missing signal days, one row per distinct result.

    The gap count is attached on (asset_tag, start_date) only, as in the source (D19): where
    one pair has several gap groups, rows multiply; a null asset tag gets a null gap.

    The enriched cases feed four branches (two signals, the per-case marks, the final join);
    with ``staged`` they are written once to the shared folder and read back, so the log's
    window pass runs once. ``days`` is the kept table of ``signals.signal_days``, which is joined
    where it lies; heartbeats and polls are then not read.

    ``first_day``/``last_day`` are the log's first and last day; when both are known (a
    date-partitioned log) the aggregate over the log that finds them is skipped. That aggregate also
    tells whether rows lack their device: then, as with ``span_days`` given, days are cut into spans
    (see ``cases``), so that the rows of the unknown device do not gather in one task.
    """
    if first_day is None or last_day is None:
        first_day, last_day, unknown = log_span(log, day, "asset_id")
        span_days = span_days or (CASE_SPAN_DAYS if unknown else None)
    builder = build_cases_legacy if legacy else build_cases
    cases = builder(log, as_of, day=day, dedupe=dedupe, first_day=first_day, span_days=span_days)
    clinic = enrich_cases(cases, assets, accounts, devices, as_of)
    if staged:
        clinic = stage_table(clinic, "enriched_cases")
    # a null tag or start never meets the gap join below, so its gap would be discarded: leave
    # those rows out of the count (exact), which also keeps a null tag from piling up its cases
    # in one partition of the gap aggregation
    joinable = clinic.filter(F.col("asset_tag").isNotNull() & F.col("start_date").isNotNull())
    gaps = missing_signal_days(joinable, heartbeats, polls, first_day, lookback=lookback,
                               strict_days=strict_days, last_day=last_day, days=days)
    return (clinic.join(gaps.select("asset_tag", "start_date", "days_with_no_heartbeat").hint("merge"),
                        ["asset_tag", "start_date"], "left")
            .select(*CASE_TABLE_COLUMNS)
            .distinct())
