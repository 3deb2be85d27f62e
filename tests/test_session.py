"""Interim tables never go to a folder that only one machine sees."""

from types import SimpleNamespace

import pytest

from postaudit.session import clear_interim, interim_dir, materialise, shared_dir


def other(master: str, conf: dict):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
                           sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(other(master, {}))
    assert shared_dir(other(master, {"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert shared_dir(other(master, {}), "hdfs:///x") == "hdfs:///x"


@pytest.mark.parametrize("master", ["local", "local[2]", "local[*]", "local[4,2]"])
def test_a_local_session_may_do_without(master):
    assert shared_dir(other(master, {}))


def test_interim_tables_are_cleared(spark, tmp_path):
    kept = materialise(spark.range(5), str(tmp_path))
    assert kept.count() == 5
    clear_interim(spark, str(tmp_path))
    import os
    assert not os.path.exists(interim_dir(spark, str(tmp_path)))
