"""Stand-in views for the warehouse tables, derived from the test data (FIXTURES.md §B).

Each view is a lazy DataFrame over a base table, so it grows with the scale factor and Catalyst
prunes the base scan to the columns a query reads. The derivation rules (modulo buckets, labels)
are the fixture's definition, not filters: they shape synthetic attributes, e.g. a device row
missing for some assets so that left-join misses are exercised.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.sources.tables import read_table


@dataclass(frozen=True)
class FixtureParams:
    """Fixed parameters for the fixtures (FIXTURES.md §C), in place of the source's dates."""

    as_of: dt.date = dt.date(2024, 1, 30)
    base_bounds: tuple[dt.date, ...] = (dt.date(2000, 12, 30), dt.date(1999, 10, 8))
    age_as_of: dt.date = dt.date(2001, 6, 30)
    app_since: dt.datetime = dt.datetime(2024, 1, 3)
    poll_since: dt.datetime = dt.datetime(2024, 1, 2)
    horizon: int = 3
    reboot_day_patterns: tuple[str, str] = ("2024-01-1%", "2024-01-2%")
    # S31 compares two waves by exact reboot time; the fixture's reboot times are day + 12:00, so
    # each wave is three such times (chosen so the two waves share assets at every scale)
    first_wave_times: tuple[str, ...] = ("2024-01-11 12:00:00", "2024-01-12 12:00:00",
                                         "2024-01-13 12:00:00")
    second_wave_times: tuple[str, ...] = ("2024-01-20 12:00:00", "2024-01-21 12:00:00",
                                          "2024-01-22 12:00:00")


PARAMS = FixtureParams()


def _mod(c: str, n: int) -> Column:
    return F.col(c) % F.lit(n)


class Fixtures:
    """All fixture views of one test-data folder, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def _t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- T1 issue log -------------------------------------------------------------------
    def _issue_rows(self, units: bool = False) -> DataFrame:
        """All errors, by device. ``units``: each user's errors are those of ten devices (told by the
        event), so that devices with a single case exist."""
        ev = self._t("events").filter(F.col("event_type") == "error")
        device = F.col("user_id") * 10 + _mod("event_id", 10) if units else F.col("user_id")
        return ev.withColumn("device", device).select(
            F.col("device").alias("ams_id"), F.col("device").alias("asset_id"), _mod("device", 25).alias("cmh_id"),
            F.col("device").alias("source_system_id"),
            F.when(_mod("device", 3) == 0, F.lit("AMP")).otherwise(F.lit("LMP")).alias("device_type"),
            F.to_date("ts").alias("date"))

    @cached_property
    def issue_log(self) -> DataFrame:
        return self._issue_rows().distinct()

    @cached_property
    def issue_log_dup(self) -> DataFrame:
        return self._issue_rows()

    @cached_property
    def issue_log_sparse(self) -> DataFrame:
        return self._issue_rows(units=True).distinct()

    # ---- T2 assets, T3 accounts, T4 devices ---------------------------------------------
    @cached_property
    def assets(self) -> DataFrame:
        c = self._t("customer")
        key = F.col("c_custkey")
        status = (F.when(_mod("c_custkey", 10) == 9, F.lit("Retired"))
                  .when(_mod("c_custkey", 2) == 0, F.lit("INSTALLED"))
                  .otherwise(F.lit("Installed")))
        return c.select(key.alias("ams_id"), F.upper("c_name").alias("asset_tag"),
                        F.concat(F.lit("SKU-"), (F.col("c_nationkey") % 4).cast("string")).alias("sku"),
                        status.alias("status"))

    @cached_property
    def accounts(self) -> DataFrame:
        n = self._t("nation")
        r = self._t("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey, "inner")
                .select(n.n_nationkey.cast("long").alias("cmh_id"),
                        n.n_name.alias("account_name"),
                        F.when(n.n_nationkey == 7, F.lit(None).cast("int"))
                        .otherwise(n.n_regionkey).alias("ranking"),
                        F.lit(None).cast("string").alias("billing_street"),
                        n.n_name.alias("billing_city"),
                        r.r_name.alias("billing_state_province")))

    @cached_property
    def devices(self) -> DataFrame:
        # some devices carry a tag that no asset has, so lookups by tag miss; no row is left out
        spare = F.when(_mod("c_custkey", 13) == 5, F.lit("/spare")).otherwise(F.lit(""))
        c = self._t("customer")
        return c.select(F.concat(F.upper("c_name"), spare).alias("asset_id"), F.col("c_custkey").alias("client_id"),
                        F.concat(F.lit("v"), (F.col("c_custkey") % 5).cast("string"))
                        .alias("device_apk_version"))

    # ---- T5 heartbeats, T6 poll history -------------------------------------------------
    @cached_property
    def heartbeats(self) -> DataFrame:
        return (self._t("events").filter(F.col("event_type").isin("view", "click"))
                .select(F.col("user_id").alias("client_id"), F.col("ts").alias("created_at")))

    @cached_property
    def polls(self) -> DataFrame:
        return (self._t("events").filter(F.col("event_type") == "signup")
                .select(F.col("user_id").alias("client_resource_id"),
                        F.col("ts").alias("poll_last_utc")))

    # ---- T7 devices history, T8 assets history ------------------------------------------
    def _orders_customer(self) -> DataFrame:
        o = self._t("orders")
        c = self._t("customer").select("c_custkey", "c_name")
        return o.join(c, o.o_custkey == c.c_custkey, "inner")

    @cached_property
    def devices_history(self) -> DataFrame:
        oc = self._orders_customer()
        pr = F.col("o_orderpriority")
        version = (F.when(pr == "4-NOT SPECIFIED", F.lit("nil"))
                   .when(pr == "3-MEDIUM", F.lit(None).cast("string")).otherwise(pr))
        day = F.to_date("o_orderdate")
        return oc.select(F.upper("c_name").alias("asset_id"), version.alias("device_apk_version"),
                         day.alias("export_date"),
                         F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
                         .otherwise(day).alias("installed_date"))

    @cached_property
    def assets_history(self) -> DataFrame:
        oc = self._orders_customer()
        st = F.col("o_orderstatus")
        status = (F.when(st == "F", F.lit("Installed")).when(st == "O", F.lit("installed"))
                  .when(st == "P", F.lit("Retired")))
        day = F.to_date("o_orderdate")
        return oc.select(
            F.col("o_custkey").alias("ams_id"), F.upper("c_name").alias("asset_tag"),
            _mod("o_custkey", 25).alias("cmh_id"), F.col("o_custkey").alias("source_system_id"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit("Exam Room Tablet"))
            .otherwise(F.lit("Waiting Room Screen")).alias("product"),
            status.alias("status"), day.alias("export_date"),
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(None).cast("date"))
            .otherwise(day).alias("deployment_date"))

    # ---- T9-T11 asset status engine -----------------------------------------------------
    @cached_property
    def asset(self) -> DataFrame:
        return self._t("customer").select(F.lower("c_name").alias("field_services_tag"),
                                          _mod("c_custkey", 200).alias("sku_id"))

    @cached_property
    def sku(self) -> DataFrame:
        return self._t("part").select(F.col("p_partkey").alias("id"),
                                      (F.col("p_size") % 3).cast("long").alias("sku_type_id"),
                                      F.col("p_brand").alias("sku_code"))

    @cached_property
    def sku_type(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self._t("region").select(
            k.cast("long").alias("id"),
            F.when(k == 0, F.lit("LINUX_MEDIA_PLAYER")).when(k == 1, F.lit("ANDROID_MEDIA_PLAYER"))
            .otherwise(F.lit("TABLET")).alias("name"))

    # ---- T12-T16 application tables and the reboot extract ------------------------------
    @cached_property
    def app_devices(self) -> DataFrame:
        return self._t("customer").select(
            F.col("c_custkey").alias("id"), F.upper("c_name").alias("asset_id"),
            F.col("c_custkey").alias("client_id"),
            F.when(_mod("c_custkey", 3) == 0, F.lit("AndroidMediaPlayer"))
            .otherwise(F.lit("LinuxMediaPlayer")).alias("type"))

    @cached_property
    def activities(self) -> DataFrame:
        v = F.col("value")
        return self._t("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("device_id"),
            F.when(F.col("event_type").isin("click", "view"), F.lit(112)).otherwise(F.lit(100))
            .alias("script_id"),
            F.when(v < 20, F.lit("acknowledged")).when(v < 60, F.lit("success"))
            .otherwise(F.lit("failed")).alias("status"),
            F.col("ts").alias("created_at"))

    @cached_property
    def taggings(self) -> DataFrame:
        return (self._t("events").filter(F.col("event_type").isin("purchase", "signup"))
                .select(F.col("user_id").alias("taggable_id"), _mod("event_id", 5).alias("tag_id"),
                        F.col("ts").alias("created_at")))

    @cached_property
    def tags(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self._t("region").select(
            k.cast("long").alias("id"),
            F.when(k.isin(0, 1), F.concat(F.lit("lmp_reboot_"), F.col("r_name")))
            .otherwise(F.concat(F.lit("other_"), F.col("r_name"))).alias("name"))

    @cached_property
    def reboots(self) -> DataFrame:
        ev = self._t("events").filter(F.col("event_type") == "purchase")
        c = self._t("customer").select("c_custkey", "c_name")
        j = ev.join(c, ev.user_id == c.c_custkey, "inner")
        text = F.concat(F.date_format(F.to_date("ts"), "yyyy-MM-dd"), F.lit(" 12:00:00"))
        return j.select(F.upper("c_name").alias("asset_id"), F.col("user_id").alias("client_id"),
                        F.when(_mod("event_id", 17) == 0, F.lit("")).otherwise(text)
                        .alias("reboot_time"))

    # ---- T17-T19 signage hosts ----------------------------------------------------------
    @cached_property
    def host(self) -> DataFrame:
        return self._t("supplier").select(
            F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("active"),
            (F.col("s_nationkey") % 3).alias("nscreens"),
            F.col("s_suppkey").alias("config_profile_bag_id"))

    @cached_property
    def bag(self) -> DataFrame:
        m = F.col("p_size") % 7
        prefix = (F.when(m == 0, F.lit("LG ")).when(m == 1, F.lit("Samsung "))
                  .when(m == 2, F.lit("Phillips ")).when(m == 3, F.lit("Philips "))
                  .when(m == 4, F.lit("Fransican ")).when(m == 5, F.lit("Samsung LG "))
                  .otherwise(F.lit("")))
        return self._t("part").select(F.col("p_partkey").alias("id"),
                                      F.concat(prefix, F.col("p_name")).alias("name"))

    @cached_property
    def monitor_poll(self) -> DataFrame:
        return self._t("events").select(F.col("user_id").alias("client_resource_id"),
                                        F.col("ts").alias("poll_last_utc"))
