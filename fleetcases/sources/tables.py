"""Base tables of the test data folder: one parquet file per table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def input_version(spark: SparkSession, sf_dir: str, names=BASE_TABLES[:8]) -> str:
    """Digest of the tables' files as they are now (name, length, time of change): tables built
    from them are kept under it, so a folder that has grown is read anew."""
    found = []
    for name in names:
        path = f"{sf_dir.rstrip('/')}/{name}.parquet"
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        except Exception:  # noqa: BLE001 - no JVM access on a remote session, or no such table
            found.append(name)
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
