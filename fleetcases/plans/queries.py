"""Every statement of the analysis as a named query: (spark, sf_dir) -> DataFrame.

materialised case table, as the source's reports read its created table. S07/S08 read the case
table of the log by single units: by user every device has several cases and both are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.constants import CASE_DEVICE_TYPE
from fleetcases.functions.dates import day_span, days_inclusive
from fleetcases.operators import base as B
from fleetcases.operators import events as E
from fleetcases.operators import reports as R
from fleetcases.operators.cases import build_cases, build_cases_legacy, flag_case_boundaries
from fleetcases.operators.lookup import device_age_years
from fleetcases.operators.signals import missing_signal_days
from fleetcases.plans.context import Context, context
from fleetcases.plans.sinks import stage_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str, order: tuple[str, ...] = ()):
    """Register a query; ``order`` is the statement's ORDER BY (``-`` = descending), with the
    remaining output columns appended where the source leaves ties unordered (D29)."""
    def register(fn: Callable[[Context], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(context(spark, sf_dir))
            return R.order_like_source(df, order) if order else df
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run
    return register


# ---- building blocks ---------------------------------------------------------------------
@query("case_boundaries")
def _case_boundaries(c: Context) -> DataFrame:
    """O1 on the issue log: every row with its open/close flags and position."""
    f = flag_case_boundaries(c.log("full"), c.p.as_of)
    return f.select("asset_id", "date", "opens", "closes", F.col("rn").cast("long").alias("rn"))


@query("cases")
def _cases(c: Context) -> DataFrame:
    """O2 on the issue log."""
    return build_cases(c.log("full"), c.p.as_of)


@query("cases_legacy")
def _cases_legacy(c: Context) -> DataFrame:
    """O3 on the issue log."""
    return build_cases_legacy(c.log("full"), c.p.as_of)


@query("cases_undeduped")
def _cases_undeduped(c: Context) -> DataFrame:
    """O2 on the log with repeated (device, day) rows, kept."""
    return build_cases(c.log("dup"), c.p.as_of, dedupe=False)


@query("missing_signal_days")
def _missing_signal_days(c: Context) -> DataFrame:
    """O5 over all O2 cases, the device id standing for client and asset."""
    log = c.log("full")
    first, last = day_span(log, "date")
    cases = (build_cases(log, c.p.as_of, first_day=first)
             .withColumn("client_id", F.col("asset_id"))
             .withColumn("case_duration",
                         days_inclusive("start_date", "close_date", c.p.as_of).cast("long")))
    cases = stage_table(cases, "signal_cases")     # read by three branches: build it once
    key = ("asset_id", "source_system_id", "start_date", "close_date", "case_duration")
    return missing_signal_days(cases, None, None, first, last_day=last, case_key=key, days=c.signal_days())


@query("latest_version")
def _latest_version(c: Context) -> DataFrame:
    """Latest known software version per device."""
    return c.latest_version()


@query("earliest_dates")
def _earliest_dates(c: Context) -> DataFrame:
    """First install and first deployment day per asset tag."""
    return c.earliest_dates()


# ---- case table and its reports (S02-S15) -----------------------------------------------
@query("case_table")
def _case_table(c: Context) -> DataFrame:
    """S02."""
    return c.case_table()


@query("case_table_undeduped")
def _case_table_undeduped(c: Context) -> DataFrame:
    """S02 on the log with repeated device days, as in the source."""
    return c.case_table("dup")


@query("case_table_sparse")
def _case_table_sparse(c: Context) -> DataFrame:
    """S02 on the sparse log."""
    return c.case_table("sparse")


@query("case_key_duplicates", order=("asset_tag", "start_date"))
def _case_key_duplicates(c: Context) -> DataFrame:
    """QC for D19: (asset_tag, start_date) pairs with several case-table rows, undeduped log."""
    return R.duplicate_keys(c.case_table("dup"), ["asset_tag", "start_date"])


@query("case_view_legacy")
def _case_view_legacy(c: Context) -> DataFrame:
    """The older view, O3 in place of O2."""
    return c.case_view()


@query("cases_by_type_total")
def _s03(c: Context) -> DataFrame:
    """Cases and cases with a missing signal day, by device type and in total."""
    return R.cases_and_missing(c.case_table())


@query("devices_by_type_total")
def _s04(c: Context) -> DataFrame:
    """Devices and devices with a missing signal day, by device type and in total."""
    return R.devices_and_missing(c.case_table())


@query("case_frequency", order=('case_cnt',))
def _s05(c: Context) -> DataFrame:
    """Devices by their number of cases."""
    return R.frequency_of_counts(c.case_table())


@query("case_frequency_by_type", order=('case_cnt', 'device_type'))
def _s06(c: Context) -> DataFrame:
    """Devices by number of cases and device type."""
    return R.frequency_of_counts(c.case_table(), dims=["device_type"])


@query("single_closed_join", order=('case_cnt', 'device_type'))
def _s07(c: Context) -> DataFrame:
    """Single-case devices with a closed case (join form), sparse log."""
    return R.closed_single_case_join(c.case_table("sparse"))


@query("single_closed_in")
def _s08(c: Context) -> DataFrame:
    """The same question in IN form, sparse log."""
    return R.closed_single_case_in(c.case_table("sparse"))


def _with_latest_version(df: DataFrame, c: Context, name: str = "software_version") -> DataFrame:
    v = c.latest_version().select(F.col("asset_id").alias("_asset"),
                                  F.col("software_version").alias(name))
    return df.join(v, df["asset_tag"] == v["_asset"], "left").drop("_asset")


@query("cases_by_version", order=('device_type', 'software_version'))
def _s09(c: Context) -> DataFrame:
    """Devices and cases by latest software version and device type."""
    ct = c.case_table().drop("software_version")
    return R.case_breakdown(_with_latest_version(ct, c), ["software_version", "device_type"])


@query("cases_by_sku", order=('device_type', 'sku'))
def _s10(c: Context) -> DataFrame:
    """Devices and cases by SKU and device type."""
    return R.case_breakdown(c.case_table(), ["sku", "device_type"])


@query("cases_by_sku_version", order=('sku', 'software_version'))
def _s11(c: Context) -> DataFrame:
    """LMP devices and cases by SKU and latest software version."""
    ct = c.case_table().filter(F.col("device_type") == CASE_DEVICE_TYPE).drop("software_version")
    return R.case_breakdown(_with_latest_version(ct, c), ["sku", "software_version"])


@query("cases_by_ranking", order=('-clinic_ranking', 'device_type'))
def _s12(c: Context) -> DataFrame:
    """Devices and cases by clinic ranking and device type."""
    return R.case_breakdown(c.case_table(), ["clinic_ranking", "device_type"])


@query("case_date_span")
def _s13(c: Context) -> DataFrame:
    """First and last case start."""
    return R.date_span(c.case_table())


@query("device_total")
def _s14(c: Context) -> DataFrame:
    """Devices with a case."""
    return E.distinct_per(c.case_table(), [], "asset_tag")


@query("device_total_by_type")
def _s15(c: Context) -> DataFrame:
    """Devices with a case by device type."""
    return E.distinct_per(c.case_table(), ["device_type"], "asset_tag")


# ---- installed base (S16-S19) -------------------------------------------------------------
@query("installed_base")
def _installed_base(c: Context) -> DataFrame:
    """The installed base at the as-of bounds, one row per distinct result."""
    return c.base().distinct()


@query("base_total")
def _s16(c: Context) -> DataFrame:
    """Installed base in total and by player type."""
    return B.installed_base_totals(c.base())


@query("base_by_sku", order=('sku_code',))
def _s17(c: Context) -> DataFrame:
    """Installed base by SKU code."""
    return B.installed_base_totals(c.base(), ["sku_code"])


@query("base_by_version", order=('device_apk_version',))
def _s18(c: Context) -> DataFrame:
    """Installed base by latest software version."""
    base = _with_latest_version(c.base(), c, "device_apk_version")
    return B.installed_base_totals(base, ["device_apk_version"])


@query("base_by_sku_version", order=('sku_code', 'device_apk_version'))
def _s19(c: Context) -> DataFrame:
    """Installed base by SKU code and software version."""
    base = _with_latest_version(c.base(), c, "device_apk_version")
    return B.installed_base_totals(base, ["sku_code", "device_apk_version"])


# ---- reboots (S20, S22-S33) -----------------------------------------------------------------
@query("earliest_reboot")
def _s20(c: Context) -> DataFrame:
    """Earliest reboot tag over players with a finished latest reboot run."""
    fx = c.fx
    return E.earliest_reboot(fx.app_devices, fx.activities, fx.taggings, fx.tags, c.p.app_since)


@query("reboot_cases")
def _s22(c: Context) -> DataFrame:
    """LMP cases with every reboot day of their clients."""
    return c.reboot_cases()


def _repeats(c: Context, horizon: int) -> DataFrame:
    """O24 on the merged timeline of cases and reboots (no reboot x case table)."""
    return E.repeat_cases(c.case_table(), c.fx.devices, c.fx.reboots, horizon)


@query("reboot_gap_hist", order=('days_btw_reboot_new_case',))
def _s23(c: Context) -> DataFrame:
    """Repeat devices and cases by days from reboot to the next case."""
    return E.histogram_of(_repeats(c, c.p.horizon))


@query("reboot_gap_hist_31", order=('days_btw_reboot_new_case',))
def _s23_31(c: Context) -> DataFrame:
    """S23 at the source's horizon of 31 days."""
    return E.histogram_of(_repeats(c, 31))


@query("repeat_after_reboot_31")
def _s32_31(c: Context) -> DataFrame:
    """S32 at the source's horizon of 31 days."""
    return E.totals_of(_repeats(c, 31))


@query("reboot_flag_frequency", order=('-reboots',))
def _s24(c: Context) -> DataFrame:
    """Devices by number of reboots inside their cases."""
    return R.frequency_of_sums(c.reboot_cases(), "asset_tag", "reboot_flag", "reboots")


def _rebooted_in_all(c: Context, *cohorts) -> DataFrame:
    """Assets rebooted in each of several cohorts of reboots: one scan of the extract."""
    return E.in_all(E.cohort_masks(c.fx.reboots, "asset_id", cohorts), len(cohorts))


@query("reboot_both_days")
def _s25(c: Context) -> DataFrame:
    """Assets rebooted on both of two days."""
    p1, p2 = c.p.reboot_day_patterns
    t = F.col("reboot_time")
    return _rebooted_in_all(c, t.like(p1), t.like(p2))


@query("rebooted_assets")
def _s26(c: Context) -> DataFrame:
    """Distinct rebooted assets."""
    return E.event_profile(c.fx.reboots)


@query("rebooted_with_case")
def _s27(c: Context) -> DataFrame:
    """Rebooted assets that also have a case."""
    tags = c.case_table().select(F.col("asset_tag").alias("asset_id"))
    both = E.cohort_overlap(tags, c.fx.reboots.select("asset_id"), "asset_id")
    return E.distinct_per(both, [], "asset_id")


@query("reboots_by_time")
def _s28(c: Context) -> DataFrame:
    """Assets per reboot time, blank included."""
    return E.event_profile(c.fx.reboots, ["reboot_time"])


@query("reboots_by_day_flagged", order=('reboot_date',))
def _s29(c: Context) -> DataFrame:
    """Assets per reboot day with the reboot inside a case."""
    rb = c.reboot_cases().filter(F.col("reboot_flag") == 1)
    return E.event_profile(rb, ["reboot_date"], key="asset_tag")


@query("reboots_by_time_with_case", order=('reboot_time',))
def _s30(c: Context) -> DataFrame:
    """Assets with a case per reboot time."""
    return E.event_profile(c.fx.reboots, ["reboot_time"], keep=c.case_table(), keep_key="asset_tag")


@query("two_wave_overlap")
def _s31(c: Context) -> DataFrame:
    """Assets rebooted in both waves."""
    t = F.col("reboot_time")
    return _rebooted_in_all(c, t.isin(*c.p.first_wave_times), t.isin(*c.p.second_wave_times))


@query("repeat_after_reboot")
def _s32(c: Context) -> DataFrame:
    """Devices and cases with a repeat case after a reboot."""
    return E.totals_of(_repeats(c, c.p.horizon))


@query("reboot_span_qc")
def _s33(c: Context) -> DataFrame:
    """QC, assets whose reboot span meets their case span."""
    return E.span_overlap_check(c.reboot_cases())


# ---- TV maker and device age (S34-S40) ------------------------------------------------------
@query("host_tv")
def _s34(c: Context) -> DataFrame:
    """Recently seen hosts with their TV maker."""
    return c.tv()


def _with_tv(df: DataFrame, c: Context, how: str) -> DataFrame:
    tv = c.tv()
    return df.join(tv, df["source_system_id"] == tv["broad_sign_id"], how).drop("broad_sign_id")


def _with_age(df: DataFrame, c: Context) -> DataFrame:
    d = c.earliest_dates().withColumnRenamed("asset_tag", "_tag")
    return (df.join(d, df["asset_tag"] == d["_tag"], "left").drop("_tag")
            .withColumn("device_age",
                        device_age_years("installed_date", "deployment_date", c.p.age_as_of)))


def _lmp_cases(c: Context) -> DataFrame:
    return c.case_table().filter(F.col("device_type") == CASE_DEVICE_TYPE)


@query("cases_by_sku_tv", order=('tv_manufacturer', 'sku'))
def _s35(c: Context) -> DataFrame:
    """LMP devices and cases by SKU and TV maker."""
    return R.case_breakdown(_with_tv(_lmp_cases(c), c, "inner"), ["sku", "tv_manufacturer"])


@query("base_by_sku_tv", order=('sku_code', 'tv_manufacturer'))
def _s36(c: Context) -> DataFrame:
    """Installed base by SKU code and TV maker."""
    return B.installed_base_totals(_with_tv(c.base(), c, "left"), ["sku_code", "tv_manufacturer"])


@query("cases_by_sku_age", order=('sku', 'device_age'))
def _s37(c: Context) -> DataFrame:
    """LMP devices and cases by SKU and device age."""
    return R.case_breakdown(_with_age(_lmp_cases(c), c), ["sku", "device_age"],
                            case_count="distinct", device_name="device_cnt")


@query("base_by_sku_age", order=('sku_code', 'device_age'))
def _s38(c: Context) -> DataFrame:
    """Installed base by SKU code and device age."""
    return B.installed_base_totals(_with_age(c.base(), c), ["sku_code", "device_age"])


@query("cases_by_four", order=('sku', 'tv_manufacturer', 'device_age', 'software_version'))
def _s39(c: Context) -> DataFrame:
    """LMP devices and cases by SKU, TV maker, age and version."""
    ct = _with_tv(_lmp_cases(c).drop("software_version"), c, "inner")
    ct = _with_latest_version(_with_age(ct, c), c)
    return R.case_breakdown(ct, ["sku", "tv_manufacturer", "device_age", "software_version"],
                            case_count="distinct", device_name="device_cnt")


@query("base_by_four", order=('sku_code', 'tv_manufacturer', 'device_age', 'device_apk_version'))
def _s40(c: Context) -> DataFrame:
    """Installed base by SKU code, TV maker, age and version."""
    base = _with_tv(_with_age(c.base(), c), c, "left")
    base = _with_latest_version(base, c, "device_apk_version")
    return B.installed_base_totals(
        base, ["sku_code", "tv_manufacturer", "device_age", "device_apk_version"])


# ---- commented-out statements (C1, C2) -----------------------------------------------------
@query("base_in_cohort", order=('name', 'sku_code'))
def _c1(c: Context) -> DataFrame:
    """Installed base of assets with a case, by SKU code and type name."""
    return B.installed_base_totals(B.restrict_to_cohort(c.base(), c.case_table()),
                                   ["sku_code", "name"])


@query("cases_reconciled_sku", order=('device_type', '-sku_2'))
def _c2(c: Context) -> DataFrame:
    """Cases by reconciled SKU and device type."""
    ct = c.case_table()
    return R.reconcile_sku(ct, B.restrict_to_cohort(c.base(), ct))
