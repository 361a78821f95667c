"""Loaded extracts: the reboot list and the host-to-TV-maker list arrive as files.

Both are read with an explicit schema (no inference pass over the data). In a CSV extract a
blank reboot time stays a blank string, as in the source, where it forms its own group (D12);
the TV-maker column is accepted under the source's spelling ``tv_manufacture`` too (D15).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REBOOT_SCHEMA = T.StructType([
    T.StructField("asset_id", T.StringType()),
    T.StructField("client_id", T.LongType()),
    T.StructField("reboot_time", T.StringType()),
])


def read_reboot_extract(spark: SparkSession, path: str, fmt: str = "csv",
                        header: bool = True) -> DataFrame:
    """asset_id, client_id, reboot_time (text; blank kept as a blank string)."""
    r = spark.read.format(fmt).schema(REBOOT_SCHEMA)
    if fmt != "csv":
        return r.load(path)
    # CSV cannot tell a blank field from a missing one: both are the source's blank time
    df = r.option("header", header).load(path)
    return df.withColumn("reboot_time", F.coalesce(F.col("reboot_time"), F.lit("")))


def read_tv_extract(spark: SparkSession, path: str, fmt: str = "csv",
                    header: bool = True) -> DataFrame:
    """broad_sign_id, tv_manufacturer (also read under the name ``tv_manufacture``)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header)
    df = r.load(path)
    if "tv_manufacture" in df.columns and "tv_manufacturer" not in df.columns:
        df = df.withColumnRenamed("tv_manufacture", "tv_manufacturer")
    return df.select(F.col("broad_sign_id").cast("long"),
                     F.col("tv_manufacturer").cast("string"))
