"""The shared folder comes from the session; only a local session without one gets its own."""

import pytest

from fleetcases import session as S


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    """Stands in for a remote session: runtime conf only, no SparkContext."""

    def __init__(self, values):
        self.conf = _Conf(values)

    @property
    def sparkContext(self):  # noqa: N802 - mirrors the pyspark attribute
        raise RuntimeError("no SparkContext on this session")


def test_configured_folder_is_used():
    s = _Session({"spark.checkpoint.dir": "hdfs://nn/shared/ckpt/", "spark.master": "yarn",
                  "spark.app.id": "app-1"})
    assert S.work_dir(s) == "hdfs://nn/shared/ckpt"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.work_dir(_Session({"spark.master": "yarn", "spark.app.id": "app-2"}))


def test_local_without_folder_gets_one_per_application():
    s = _Session({"spark.master": "local[2]", "spark.app.id": "app-3"})
    d = S.work_dir(s)
    assert d and S.work_dir(s) == d
    assert S.work_dir(_Session({"spark.master": "local[2]", "spark.app.id": "app-4"})) != d


def test_real_session_reads_its_setting(spark):
    assert S.work_dir(spark)
    assert S.app_id(spark) == spark.sparkContext.applicationId


def test_public_names_resolve():
    import fleetcases.functions as fn
    import fleetcases.operators as ops
    import fleetcases.plans as plans
    import fleetcases.sources as src
    for mod in (fn, ops, plans, src):
        for name in mod.__all__:
            assert callable(getattr(mod, name)) or name.isupper() or name == "PARAMS", name


def test_command_line(spark, capsys):
    from fleetcases.__main__ import main
    assert main(["list"]) == 0
    listed = capsys.readouterr().out.splitlines()
    assert len(listed) == 54 and listed[0].startswith("case_boundaries")
    assert main(["show", "case_date_span", "/root/testdata/sf0.001"]) == 0
    assert "min_start_date" in capsys.readouterr().out
