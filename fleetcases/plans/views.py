"""The older case table as a catalog view (S41, ``create or replace view``).

The view is SQL text over the input tables, so nothing is frozen: each use plans it anew over the files
the tables then have, and a day appended to the log is in the next answer. Its ``as_of`` is a parameter of
the view: the clock (the source's ``getdate()``) unless a day is given, or the session variable that
``set_as_of`` changes under a view that already exists.

The text follows the plans of the operators: one row per device and day by a hash aggregate before the
windows, one row per client and day of each signal, an equi-join on bins of days as wide as the lookback,
and the days seen as or-ed bits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from fleetcases.constants import INSTALLED_STATUS, LOOKBACK_DAYS

INPUTS = ("log", "assets", "accounts", "devices", "heartbeats", "polls")
_VARIABLE = "fleetcases_as_of"


def _seen(name: str, signal: str, entity: str, ts: str, on: str, since: str, first: int, edge: str, lookback: int) -> str:
    """Bits of the days before each case on which a signal was seen: one CTE body."""
    width = lookback + 1
    return f"""SELECT k.asset_tag, k.source_system_id, k.start_date, k.close_date, k.case_duration,
        bit_or(shiftleft(1L, datediff(k.start_date, s.day))) AS days
    FROM (SELECT *, explode(sequence(CAST(floor(unix_date(date_sub(start_date, {first})) / {width}) AS INT),
                                     CAST(floor(unix_date(date_sub(start_date, 1)) / {width}) AS INT))) AS bin
          FROM clinic WHERE start_date IS NOT NULL) k
    JOIN (SELECT {entity} AS entity, to_date({ts}) AS day, max({ts}) AS last_ts,
                 CAST(floor(unix_date(to_date({ts})) / {width}) AS INT) AS bin
          FROM {signal} WHERE to_date({ts}) >= {since} GROUP BY {entity}, to_date({ts})) s
      ON s.entity = k.{on} AND s.bin = k.bin
     AND s.day BETWEEN date_sub(k.start_date, {first}) AND date_sub(k.start_date, 1){edge}
    GROUP BY ALL"""


def case_view_sql(tables: Mapping[str, str], as_of: str = "current_date()", lookback: int = LOOKBACK_DAYS) -> str:
    """Text of the view over the tables named in ``tables`` (keys ``INPUTS``); ``as_of`` is SQL too.

    ``lookback`` may be up to 61 days (the days seen are the bits of one long).
    """
    if not 0 < lookback <= 61:
        raise ValueError("lookback must be from 1 to 61 days")
    t = {k: tables[k] for k in INPUTS}
    first_day = f"(SELECT min(to_date(date)) FROM {t['log']})"
    midnight = f" AND (s.day > date_sub(k.start_date, {lookback + 1}) OR s.last_ts > date_sub(k.start_date, {lookback + 1}))"
    beats = _seen("beats", t["heartbeats"], "client_id", "created_at", "client_id", first_day, lookback + 1, midnight, lookback)
    polls = _seen("polls", t["polls"], "client_resource_id", "poll_last_utc", "source_system_id",
                  f"date_sub({first_day}, {lookback + 1})", lookback, "", lookback)
    key = "asset_tag, source_system_id, start_date, close_date, case_duration"
    same = " AND ".join(f"{{0}}.{c.strip()} <=> g.{c.strip()}" for c in key.split(","))
    return f"""WITH variants AS (
    SELECT asset_id, date, ams_id, cmh_id, source_system_id, device_type, count(*) AS n
    FROM {t['log']} WHERE date IS NOT NULL GROUP BY ALL),
days AS (
    SELECT asset_id, date, min(struct(ams_id, cmh_id, source_system_id, device_type)) AS a
    FROM variants GROUP BY asset_id, date),
flags AS (
    SELECT *, coalesce(before IS NULL OR datediff(date, before) <> 1, false) AS opens,
           coalesce((after IS NULL AND date <> {as_of}) OR datediff(after, date) > 1, false) AS closes
    FROM (SELECT *, lag(date) OVER w AS before, lead(date) OVER w AS after
          FROM days WINDOW w AS (PARTITION BY asset_id ORDER BY date))),
bounds AS (
    SELECT *, lead(CASE WHEN closes THEN date END) OVER (PARTITION BY asset_id ORDER BY date) AS next_close
    FROM flags WHERE opens OR closes),
cases AS (
    SELECT DISTINCT a.ams_id, asset_id, a.cmh_id, a.source_system_id, a.device_type,
           CASE WHEN opens THEN date ELSE {first_day} END AS start_date, next_close AS close_date
    FROM bounds WHERE opens OR next_close IS NOT NULL),
clinic AS (
    SELECT c.ams_id, c.source_system_id, c.cmh_id, a.asset_tag, c.device_type, c.start_date, c.close_date, a.sku,
           d.software_version, CAST(datediff(coalesce(c.close_date, {as_of}), c.start_date) + 1 AS BIGINT) AS case_duration,
           b.account_name, b.ranking AS clinic_ranking, b.billing_street AS street, b.billing_city AS city,
           b.billing_state_province AS state, d.client_id
    FROM cases c
    JOIN (SELECT DISTINCT ams_id, asset_tag, sku FROM {t['assets']}
          WHERE upper(status) = '{INSTALLED_STATUS.upper()}') a ON a.ams_id = c.ams_id
    LEFT JOIN {t['accounts']} b ON b.cmh_id = c.cmh_id
    LEFT JOIN (SELECT DISTINCT asset_id, client_id, device_apk_version AS software_version
               FROM {t['devices']}) d ON d.asset_id = a.asset_tag),
beats AS (
    {beats}),
polls AS (
    {polls}),
gaps AS (
    SELECT g.asset_tag, g.start_date,
           CAST({lookback} - coalesce(bit_count(h.days), bit_count(p.days), 0) AS BIGINT) AS days_with_no_heartbeat
    FROM (SELECT DISTINCT {key} FROM clinic WHERE asset_tag IS NOT NULL AND start_date IS NOT NULL) g
    LEFT JOIN beats h ON {same.format('h')}
    LEFT JOIN polls p ON {same.format('p')})
SELECT DISTINCT k.ams_id, k.source_system_id, k.cmh_id, k.asset_tag, k.device_type, k.start_date, k.close_date,
       k.sku, k.software_version, k.case_duration, k.account_name, k.clinic_ranking, k.street, k.city, k.state,
       k.client_id, g.days_with_no_heartbeat
FROM clinic k LEFT JOIN gaps g ON g.asset_tag = k.asset_tag AND g.start_date = k.start_date"""


def create_case_view(spark: SparkSession, name: str, tables: Mapping[str, str], as_of: dt.date | None = None,
                     temporary: bool = False, variable: bool = False, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Create or replace the catalog view ``name`` over tables of the catalog; returns it as a frame.

    ``as_of`` None is the day of each use. ``temporary`` views may stand on temporary views and, with
    ``variable``, take their day from the session (``set_as_of``).
    """
    if variable:
        if not temporary:
            raise ValueError("only a temporary view can read a session variable")
        set_as_of(spark, as_of)
        day = _VARIABLE
    else:
        day = f"DATE '{as_of.isoformat()}'" if as_of else "current_date()"
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    spark.sql(f"CREATE OR REPLACE {kind} {name} AS {case_view_sql(tables, day, lookback)}")
    return spark.table(name)


def set_as_of(spark: SparkSession, as_of: dt.date | None) -> None:
    """The day that views made with ``variable`` are worked out for, from now on (None: today)."""
    value = f"DATE '{as_of.isoformat()}'" if as_of else "current_date()"
    spark.sql(f"DECLARE OR REPLACE VARIABLE {_VARIABLE} DATE DEFAULT {value}")
