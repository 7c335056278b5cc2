"""The shared folder and size checks."""

from types import SimpleNamespace

import pytest

from quire.sources.shared import light, shared_folder


def session(master, folder=None, checkpoint=None):
    conf = SimpleNamespace(get=lambda key: folder)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: checkpoint))


def test_a_cluster_must_name_its_folder():
    assert shared_folder(session("spark://h:7077", "hdfs:///x/")) == "hdfs:///x"
    assert shared_folder(session("spark://h:7077", None, "file:/shared/c")) == "file:/shared/c"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://h:7077"))
    assert shared_folder(session("local[2]")).startswith("/")


def test_only_few_rows_are_broadcast(spark):
    few, many = light(spark.range(5), 5), light(spark.range(6), 5)
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(few) and "broadcast" not in plan(many)
