"""Installed base: assets in service at an as-of date, and their totals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.constants import ANDROID_PLAYER, BASE_PRODUCT, BASE_STATUS, LINUX_PLAYER
from fleetcases.functions.dates import as_of_filter
from fleetcases.operators.lookup import join_ignore_case


BASE_COLUMNS = ("ams_id", "asset_tag", "source_system_id", "sku_code", "name")


def installed_base(assets_history: DataFrame, accounts: DataFrame, asset: DataFrame,
                   sku: DataFrame, sku_type: DataFrame, bounds: Sequence[dt.date] | dt.date,
                   product: str = BASE_PRODUCT, status: str = BASE_STATUS) -> DataFrame:
    """History rows of one product and status, at accounts with a ranking, exported no
    later than the as-of bounds, with their SKU code and SKU type name.

    Filters run first, on raw columns, so they reach the scan. The account test only keeps or
    drops rows (a semi join): every consumer counts distinct assets, so a duplicated account
    never matters, and nothing from accounts is carried. The SKU lookup matches asset tags
    case-insensitively; misses keep null SKU columns.
    """
    h = assets_history.filter((F.col("product") == product) & (F.col("status") == status))
    h = as_of_filter(h, "export_date", bounds)
    # The history holds one row per asset and export day; every consumer counts distinct
    # assets, so the daily copies collapse here, map-side, before any join.
    h = h.select("ams_id", "asset_tag", "source_system_id", "cmh_id").distinct()
    ranked = accounts.filter(F.col("ranking").isNotNull()).select("cmh_id").distinct()
    h = h.join(ranked, "cmh_id", "left_semi").drop("cmh_id")
    # One row per (tag, SKU) on the lookup side: a tag shared by many rows (a placeholder
    # value) then matches each history row once per SKU, not once per duplicate.
    a = asset.select("field_services_tag", "sku_id").distinct()
    s = sku.select(F.col("id").alias("sku_id"), "sku_type_id", "sku_code")
    t = sku_type.select(F.col("id").alias("sku_type_id"), "name")
    out = (join_ignore_case(h, a, "asset_tag", "field_services_tag", "left")
           .join(s, "sku_id", "left")
           .join(t, "sku_type_id", "left"))
    return out.select(*BASE_COLUMNS)


def installed_base_totals(base: DataFrame, dims: Sequence[str] = (), key: str = "ams_id",
                          type_col: str = "name") -> DataFrame:
    """Distinct assets overall and of the two player types, per ``dims`` (or in total).

    Two plain aggregates instead of three distinct counts: one row per (dims, asset) carrying
    whether the asset is of each type, then counts per dims.
    """
    t = F.col(type_col)
    per_asset = base.groupBy(*dims, key).agg(
        F.max(F.when(t == LINUX_PLAYER, 1).otherwise(0)).alias("_lmp"),
        F.max(F.when(t == ANDROID_PLAYER, 1).otherwise(0)).alias("_amp"))
    known = F.col(key).isNotNull()
    return per_asset.groupBy(*dims).agg(
        F.count(key).alias("total_wrs"),
        F.sum(F.when(known, F.col("_lmp")).otherwise(0)).cast("long").alias("total_lmp"),
        F.sum(F.when(known, F.col("_amp")).otherwise(0)).cast("long").alias("total_amp"))


def restrict_to_cohort(base: DataFrame, cases: DataFrame, base_key: str = "asset_tag",
                       case_key: str = "asset_tag") -> DataFrame:
    """Base rows whose upper-cased tag is one of the case table's tags (a semi join)."""
    tags = cases.select(F.col(case_key).alias("_tag")).distinct()
    return base.join(tags, F.upper(base[base_key]) == tags["_tag"], "left_semi")
