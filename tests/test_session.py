"""Checkpoint folder and scratch tables."""

import types

import pytest

from spindle import session


def _without_folder(spark, master):
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=lambda d: None)
    return types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d=None: d))


@pytest.mark.parametrize("master", ["spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"])
def test_cluster_without_shared_folder_is_an_error(spark, master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        session.checkpoint_dir(_without_folder(spark, master))


def test_local_session_gets_a_folder(spark):
    assert session.checkpoint_dir(_without_folder(spark, "local[2]"))
    assert session.checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_scratch_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    df = session.materialize(spark.range(5), "gone")
    path = df.inputFiles()[0]
    assert df.count() == 5 and session.remove_scratch(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
