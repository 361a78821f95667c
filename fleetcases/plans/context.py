"""Per-session access to the inputs and to the tables the analysis materialises.

The source writes two tables (the case table, the reboot x case table) and loads two extracts
(reboots, TV makers); every report reads those. Here each is built once per session and input
folder, written as parquet to the shared folder and read back (see ``sinks.materialized``).
The installed base and the two per-asset lookups are shared the same way, since seven totals
statements repeat the same join chain over the assets history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcases.operators.base import installed_base
from fleetcases.operators.events import attach_events, recently_seen_hosts
from fleetcases.operators.lookup import earliest_known, latest_known
from fleetcases.operators.signals import SIGNAL_KEYS, signal_days
from fleetcases.plans.case_table import build_case_table
from fleetcases.plans.sinks import as_view, materialized
from fleetcases.plans.views import INPUTS, create_case_view
from fleetcases.session import session_key
from fleetcases.sources.fixtures import PARAMS, FixtureParams, Fixtures
from fleetcases.sources.tables import input_version


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str, params: FixtureParams = PARAMS,
                 version: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.p = params
        self.version = version or input_version(spark, self.sf_dir)
        self.fx = Fixtures(spark, self.sf_dir)

    def _keep(self, name: str, build, *parts, bucket_by=()) -> DataFrame:
        key = "|".join(str(x) for x in (self.sf_dir, self.version, self.p, *parts))
        return materialized(self.spark, name, key, build, bucket_by)

    def log(self, which: str = "full") -> DataFrame:
        return {"full": self.fx.issue_log, "sparse": self.fx.issue_log_sparse,
                "dup": self.fx.issue_log_dup}[which]

    # ---- lazy builders (plans only; ``scripts/plan_summary.py`` prints them) ----------------
    def build_case_table(self, which: str = "full", legacy: bool = False,
                         staged: bool = True) -> DataFrame:
        fx = self.fx
        return build_case_table(self.log(which), fx.assets, fx.accounts, fx.devices,
                                None, None, self.p.as_of, legacy=legacy,
                                dedupe=which != "dup", staged=staged, days=self.signal_days())

    def build_reboot_cases(self, which: str = "full") -> DataFrame:
        return attach_events(self.case_table(which), self.fx.devices, self.fx.reboots,
                             self.p.as_of)

    def build_tv(self) -> DataFrame:
        fx = self.fx
        return recently_seen_hosts(fx.host, fx.bag, fx.monitor_poll, self.p.poll_since)

    def build_base(self) -> DataFrame:
        fx = self.fx
        return installed_base(fx.assets_history, fx.accounts, fx.asset, fx.sku, fx.sku_type,
                              self.p.base_bounds)

    def build_latest_version(self) -> DataFrame:
        return latest_known(self.fx.devices_history, "asset_id", "device_apk_version",
                            "export_date", out_value="software_version")

    def build_earliest_dates(self) -> DataFrame:
        """O12 twice: first install day (devices history) and first deployment day (assets
        history) per asset tag, as one table. A union then one grouping, no outer join."""
        inst = earliest_known(self.fx.devices_history, "asset_id", "installed_date",
                              out_key="asset_tag")
        dep = earliest_known(self.fx.assets_history, "asset_tag", "deployment_date")
        both = (inst.select("asset_tag", "installed_date",
                            F.lit(None).cast("date").alias("deployment_date"))
                .unionByName(dep.select("asset_tag", F.lit(None).cast("date").alias("installed_date"),
                                        "deployment_date")))
        return both.groupBy("asset_tag").agg(F.min("installed_date").alias("installed_date"),
                                             F.min("deployment_date").alias("deployment_date"))

    # ---- materialised tables -------------------------------------------------------------
    def signal_days(self) -> DataFrame:
        """Heartbeats and polls by entity and day, bucketed by what the case tables join them on."""
        return self._keep("signal_days", lambda: signal_days(self.fx.heartbeats, self.fx.polls), bucket_by=SIGNAL_KEYS)

    def case_table(self, which: str = "full", legacy: bool = False) -> DataFrame:
        """S02 (``legacy=True``: the S41 view's rule)."""
        return self._keep("case_table", lambda: self.build_case_table(which, legacy), which, legacy)

    def case_view(self) -> DataFrame:
        """S41 as the source has it: a view over the inputs, worked out at each use."""
        tag = f"{abs(hash((self.sf_dir, self.version))):x}"
        fx = self.fx
        frames = dict(zip(INPUTS, (fx.issue_log, fx.assets, fx.accounts, fx.devices, fx.heartbeats, fx.polls), strict=True))
        for name, df in frames.items():
            as_view(df, f"fx_{name}_{tag}")
        return create_case_view(self.spark, f"case_view_legacy_{tag}", {n: f"fx_{n}_{tag}" for n in frames},
                                self.p.as_of, temporary=True)

    def reboot_cases(self, which: str = "full") -> DataFrame:
        """Reboot x case table."""
        return self._keep("reboot_cases", lambda: self.build_reboot_cases(which), which)

    def tv(self) -> DataFrame:
        """S34 result, kept as the TV-maker extract the later statements read."""
        return self._keep("host_tv", self.build_tv)

    def base(self) -> DataFrame:
        """O14 installed base at the fixture's as-of bounds."""
        return self._keep("installed_base", self.build_base)

    def latest_version(self) -> DataFrame:
        """O11 over the devices history: asset_id, software_version."""
        return self._keep("latest_version", self.build_latest_version)

    def earliest_dates(self) -> DataFrame:
        """asset_tag, installed_date, deployment_date."""
        return self._keep("earliest_dates", self.build_earliest_dates)


    def register_views(self, prefix: str = "") -> list[str]:
        """``create or replace view`` for the created tables, so reports can also be written as
        SQL over them (``spark.sql``): case_table, case_table_sparse, case_view_legacy,
        reboot_cases, host_tv, installed_base. Returns the view names."""
        views = {"case_table": self.case_table(), "case_table_sparse": self.case_table("sparse"),
                 "case_view_legacy": self.case_view(),
                 "reboot_cases": self.reboot_cases(), "host_tv": self.tv(),
                 "installed_base": self.base()}
        for name, df in views.items():
            as_view(df, prefix + name)
        return [prefix + n for n in views]


_CONTEXTS: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    """The context of a session and input folder; a new one when the folder's files have changed
    since (its frames and shared tables belong to one listing of the files)."""
    k = (session_key(spark), sf_dir.rstrip("/"))
    version = input_version(spark, sf_dir)
    if k not in _CONTEXTS or _CONTEXTS[k].version != version:
        _CONTEXTS[k] = Context(spark, sf_dir, version=version)
    return _CONTEXTS[k]
