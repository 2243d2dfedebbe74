"""Which folder tables between steps are written to."""

from types import SimpleNamespace

import pytest

from leaseloom.sources.folders import shared_folder, shared_root


def session(conf=None, context_dir=None, master="local[4]", app="a"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf if key == "spark.checkpoint.dir" and conf else default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: context_dir, master=master, applicationId=app))


def test_the_named_folder_comes_first():
    assert shared_root(session("hdfs://x/y/", "hdfs://z")) == "hdfs://x/y"
    assert shared_folder(session("hdfs://x/y")).startswith("hdfs://x/y/leaseloom/")


def test_else_that_of_the_context():
    assert shared_root(session(None, "hdfs://z")) == "hdfs://z"


def test_a_local_session_may_use_a_temporary_one():
    assert shared_root(session(app="b")) == shared_root(session(app="b")) != shared_root(session(app="c"))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://h", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_one(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session(master=master))
