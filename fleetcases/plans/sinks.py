"""Table and view sinks.

A table the source creates with ``drop`` + ``create table as`` is written once as parquet into
the session's shared folder (``spark.checkpoint.dir``), then read back. That cuts the lineage: later
reports read a few columns of a small file set instead of re-running the pipeline, and a lost executor
costs a re-read, not a recomputation from the raw log.

Replacing is a versioned swap, not a drop: the new rows go to a folder of their own, one pointer is then
moved to it (a small file renamed over the old one, or the location of a catalog table), and only then the
old folder goes. A build that dies half-way leaves the old table as it was; what it wrote is cleared by
the next build of the table. A table has one writer at a time; a reader that began on the old version
should be done before the next but one replacement.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from fleetcases.session import app_id, delete_at_exit, file_system, session_key, work_dir

_WRITTEN: dict[tuple[str, str], str] = {}
_SCANS: dict[tuple[str, tuple[str, str]], DataFrame] = {}
#: this driver process: two applications without an id of their own do not share a folder
_RUN = uuid.uuid4().hex[:12]
_GUARD = threading.Lock()
_BUILDING: dict[tuple[str, str], threading.Lock] = {}
_POINTER = "_current"
#: staged folders of the builds that run in this thread
_STAGED = threading.local()


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version a table's pointer names; None when the table does not exist."""
    fs, p = file_system(spark, f"{path}/{_POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        name = bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()
    return f"{path}/{name}"


def _move_pointer(spark: SparkSession, path: str, version: str) -> None:
    """Commit: the pointer is written beside the old one and renamed over it in one step."""
    jvm = spark._jvm
    fs, new = file_system(spark, f"{path}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    _, pointer = file_system(spark, f"{path}/{_POINTER}")
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    qualified = fs.makeQualified(new)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(qualified, fs.makeQualified(pointer), options)


def _clear(spark: SparkSession, path: str, keep: Sequence[str | None]) -> None:
    """Delete the folders of a table but those named (leftovers of builds that died, old versions)."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return
    names = {k.rsplit("/", 1)[-1] for k in keep if k}
    for f in fs.listStatus(root):
        if f.isDirectory() and f.getPath().getName() not in names:
            fs.delete(f.getPath(), True)


def replace_table(df: DataFrame | Callable[[], DataFrame], path: str, spark: SparkSession | None = None,
                  partition_by: str | None = None) -> DataFrame:
    """Replace the table at ``path`` by ``df`` (or what it builds) in a versioned swap; returns a scan.

    Folders that the build stages are deleted when the table is committed, or the build fails.
    """
    spark = spark or df.sparkSession
    old = current_version(spark, path)
    _clear(spark, path, [old])
    version = f"v-{uuid.uuid4().hex}"
    outer, _STAGED.paths = getattr(_STAGED, "paths", None), []
    try:
        frame = df() if callable(df) else df
        w = frame.write.partitionBy(partition_by) if partition_by else frame.write
        w.parquet(f"{path}/{version}")
        _move_pointer(spark, path, version)
    finally:
        staged, _STAGED.paths = _STAGED.paths, outer
        for folder in staged:
            fs, p = file_system(spark, folder)
            fs.delete(p, True)
    _clear(spark, path, [version])
    return spark.read.parquet(f"{path}/{version}")


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the committed version of a table written by ``replace_table``."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed table at {path}")
    return spark.read.parquet(version)


def drop_table(spark: SparkSession, path: str) -> None:
    """Drop a table written by ``replace_table``: its pointer first, so no reader finds half of it."""
    fs, pointer = file_system(spark, f"{path}/{_POINTER}")
    fs.delete(pointer, False)
    fs.delete(file_system(spark, path)[1], True)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Overwrite ``path`` with ``df`` as parquet and return a scan of it.

    ``partition_by`` lays the files out by a column (a daily log or snapshot by its day), so
    filters on it prune whole folders when the table is read back.
    """
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back: its consumers scan a small file
    set instead of each re-running its lineage, and a lost executor re-reads, not recomputes.
    It is deleted with the build it belongs to (``replace_table``), else when the application ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    paths = getattr(_STAGED, "paths", None)
    if paths is not None:
        paths.append(path)
    delete_at_exit(spark, path)
    return write_table(df, path)


def write_bucketed(df: DataFrame, path: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Write ``df`` as an external catalog table bucketed and sorted by ``keys`` (one file a bucket, as
    many as the session's shuffle partitions): equi-joins on the keys read it where it lies."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(n, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, *keys).sortBy(*keys).saveAsTable(name))
    return spark.table(name)


def materialized(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame],
                 bucket_by: Sequence[str] = ()) -> DataFrame:
    """Build ``name`` once per session and key (the inputs and parameters), then reuse it.

    With ``bucket_by`` the table is bucketed by these columns; its catalog entry belongs to the session.
    """
    app = app_id(spark)
    digest = hashlib.sha1(key.encode()).hexdigest()[:12]
    k = (app, name + digest)
    with _GUARD:
        lock = _BUILDING.setdefault(k, threading.Lock())
    with lock:   # queries run from several threads build each table once, not concurrently
        scan = _SCANS.get((session_key(spark), k))
        if k not in _WRITTEN:
            path = f"{work_dir(spark)}/{app}-{_RUN}/{name}-{digest}"
            if bucket_by:
                scan = write_bucketed(build(), path, f"fleetcases_{name}_{digest}_{_RUN}", bucket_by)
                _WRITTEN[k] = path
            else:
                scan = replace_table(build, path, spark)
                _WRITTEN[k] = current_version(spark, path)
            delete_at_exit(spark, path)
        elif scan is None:
            table = f"fleetcases_{name}_{digest}_{_RUN}"
            # one scan per session: later calls skip listing the folder and reading the footers
            scan = spark.table(table) if bucket_by else spark.read.parquet(_WRITTEN[k])
        _SCANS[(session_key(spark), k)] = scan
    return scan


def save_as_table(df: DataFrame, name: str) -> DataFrame:
    """``drop table`` + ``create table as`` for a catalog table, as a versioned swap: the rows are written
    to a new folder, the table's location is moved there, the old folder is deleted. ``df`` may read the
    table it replaces."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tables/{name}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    old = None
    if spark.catalog.tableExists(name):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
        old = rows[0]["data_type"] if rows else None
        if spark.table(name).schema == df.schema and old and "/v-" in old:
            spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
            spark.catalog.refreshTable(name)
        else:       # other columns, or a table that is not ours: its rows are in place already
            spark.sql(f"DROP TABLE {name}")
            spark.catalog.createTable(name, path=path, source="parquet")
    else:
        spark.catalog.createTable(name, path=path, source="parquet")
    if old and "/v-" in old:
        fs, p = file_system(spark, old)
        fs.delete(p, True)
    return spark.table(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """``create or replace view``: a session view over the lazy plan."""
    df.createOrReplaceTempView(name)
    return df
