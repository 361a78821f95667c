"""Tables replaced by a versioned swap: a build that dies leaves the old one, nothing staged stays."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetcases.plans.sinks import (current_version, drop_table, materialized, read_version, replace_table, save_as_table,
                                    stage_table)
from fleetcases.session import work_dir


def _n(df):
    return sorted(r[0] for r in df.collect())


def test_replace_and_drop(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert current_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    assert _n(replace_table(spark.range(3), path)) == [0, 1, 2]
    assert _n(replace_table(read_version(spark, path).filter("id > 0"), path)) == [1, 2]      # reads what it replaces
    assert _n(read_version(spark, path)) == [1, 2]
    assert len(glob.glob(f"{tmp_path}/t/v-*")) == 1
    replace_table(spark.range(4).withColumn("p", F.col("id") % 2), path, partition_by="p")
    assert "PartitionFilters: [isnotnull(p" in read_version(spark, path).filter("p = 1")._jdf.queryExecution().toString()
    drop_table(spark, path)
    assert current_version(spark, path) is None and not os.path.exists(f"{tmp_path}/t")


def test_a_build_that_dies_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    replace_table(spark.range(5), path)

    def dies_while_writing():
        return spark.range(1000, numPartitions=4).select(
            F.when(F.col("id") > 700, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))

    def dies_while_building():
        staged = stage_table(spark.range(9), "half")
        staged.filter("no_such_column > 1")

    for build in (dies_while_writing, dies_while_building):
        with pytest.raises(Exception):  # noqa: B017
            replace_table(build, path, spark)
        assert _n(read_version(spark, path)) == [0, 1, 2, 3, 4]
    assert not glob.glob(f"{work_dir(spark)}/stage/half-*")
    os.makedirs(f"{tmp_path}/t/v-left-by-a-killed-driver")
    assert _n(replace_table(spark.range(2), path)) == [0, 1]
    assert len(glob.glob(f"{tmp_path}/t/v-*")) == 1


def test_staged_folders_go_with_the_build(spark):
    def build():
        a = stage_table(spark.range(10), "gone_a")
        return a.join(stage_table(spark.range(5), "gone_b"), "id")
    assert _n(materialized(spark, "staging_test", "k1", build)) == [0, 1, 2, 3, 4]
    assert not glob.glob(f"{work_dir(spark)}/stage/gone_*")


def test_catalog_table_is_swapped(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS fc_swap LOCATION '{tmp_path / 'db'}'")
    try:
        name = "fc_swap.t"
        assert _n(save_as_table(spark.range(3), name)) == [0, 1, 2]
        assert _n(save_as_table(spark.table(name).filter("id < 2"), name)) == [0, 1]       # reads what it replaces
        with pytest.raises(Exception):  # noqa: B017
            save_as_table(spark.range(9).select(F.raise_error(F.lit("lost")).cast("long").alias("id")), name)
        assert _n(spark.table(name)) == [0, 1]
        assert save_as_table(spark.range(2).withColumn("x", F.lit("a")), name).columns == ["id", "x"]    # other columns
        assert spark.table(name).count() == 2
    finally:
        spark.sql("DROP DATABASE fc_swap CASCADE")
