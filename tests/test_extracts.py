"""Extract files read back give the same reports as the fixture frames (blank times kept)."""

from conftest import SF_MID, rows
from fleetcases.operators.events import distinct_per
from fleetcases.plans.context import context
from fleetcases.sources.extracts import read_reboot_extract, read_tv_extract


def test_reboot_extract_csv_round_trip(spark, tmp_path):
    rb = context(spark, SF_MID).fx.reboots
    path = str(tmp_path / "reboots_csv")
    rb.write.option("header", True).csv(path)
    back = read_reboot_extract(spark, path)
    assert back.filter("reboot_time = ''").count() == rb.filter("reboot_time = ''").count() > 0
    assert rows(distinct_per(back, ["reboot_time"], "asset_id")) == \
        rows(distinct_per(rb, ["reboot_time"], "asset_id"))          # S28, blank group included


def test_tv_extract_accepts_the_source_spelling(spark, tmp_path):
    tv = context(spark, SF_MID).tv()
    path = str(tmp_path / "tv_csv")
    tv.withColumnRenamed("tv_manufacturer", "tv_manufacture").write.option("header", True).csv(path)
    assert rows(read_tv_extract(spark, path)) == rows(tv)
