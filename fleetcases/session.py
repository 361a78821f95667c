"""Session settings and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on; a cluster launcher may set more (shuffle partitions sized to
# the data, executor memory), these are the ones the results or plans depend on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only what the planner or AQE has measured below this size; larger sides fall
    # back to a shuffled join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


# Sizing for the full data (about 100 TB over about 1000 executors): start shuffles wide and let
# AQE coalesce them to ~256 MB partitions, split scans at 512 MB, and treat partitions over 1 GB
# (and 5x the median) as skewed. spark.checkpoint.dir must point at shared storage.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "fleetcases",
                extra: dict[str, str] | None = None, profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``profile="local"`` (tests, bench) sizes shuffles for one machine; ``profile="cluster"``
    applies ``CLUSTER_CONF``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SESSION_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    else:
        conf.update({
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("FLEETCASES_DRIVER_MEMORY", "8g"),
        })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    if profile == "cluster":
        for k, v in CLUSTER_CONF.items():
            spark.conf.set(k, v)
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        value = spark.conf.get(key, None)
    except Exception:  # noqa: BLE001 - some keys are not readable through the runtime conf
        value = None
    if value:
        return value
    try:
        return spark.sparkContext.getConf().get(key, None)
    except Exception:  # noqa: BLE001 - no SparkContext on a remote (Connect) session
        return None


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application (tables written by it are keyed by it)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        return _conf(spark, "spark.app.id") or "app"


def session_key(spark: SparkSession) -> str:
    """Identifier of a session object, never used again for another one."""
    if not hasattr(spark, "_fleetcases_key"):
        spark._fleetcases_key = uuid.uuid4().hex
    return spark._fleetcases_key


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: the session's ``spark.checkpoint.dir``.

    On a cluster this must be set by the launcher to storage every executor can reach. Only a
    local-mode session (tests, bench) without one gets a fresh folder of its own.
    """
    d = _conf(spark, "spark.checkpoint.dir")
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001
            d = None
    if d:
        return d.rstrip("/")
    app = app_id(spark)
    if app in _LOCAL_DIRS:
        return _LOCAL_DIRS[app]
    master = _conf(spark, "spark.master") or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder "
                           "(e.g. on the cluster's distributed file system)")
    d = tempfile.mkdtemp(prefix="fleetcases-")
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001
        pass
    _LOCAL_DIRS[app] = d
    return d


def file_system(spark: SparkSession, path: str):
    """The file system that holds ``path`` (whatever store Spark reads) and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder of the shared store deleted when the application ends."""
    try:
        fs, p = file_system(spark, path)
        fs.deleteOnExit(p)
    except AttributeError:     # a remote session has no file system of its own
        pass
