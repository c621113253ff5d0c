"""The shared scratch folder: named by the cluster, never a machine's own disk beside other machines."""

from types import SimpleNamespace

import pytest

from forum_signals.session import CHECKPOINT_KEY, scratch_path, shared_dir


def session(**conf):
    settings = {key.replace("__", "."): value for key, value in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, *default: settings.get(key, *default)))


def test_the_named_folder_comes_first():
    named = session(**{CHECKPOINT_KEY: "hdfs:///tmp/shared/"}, spark__sql__warehouse__dir="file:/w", spark__master="yarn")
    assert shared_dir(named) == "hdfs:///tmp/shared"
    assert scratch_path(named, "x").startswith("hdfs:///tmp/shared/forum_signals/x-")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_one_machine_may_use_its_own_warehouse(master):
    assert shared_dir(session(spark__sql__warehouse__dir="file:/w/", spark__master=master)) == "file:/w/_scratch"


def test_a_shared_warehouse_serves_a_cluster():
    assert shared_dir(session(spark__sql__warehouse__dir="s3a://b/w", spark__master="yarn")) == "s3a://b/w/_scratch"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_refuses_a_local_warehouse(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(spark__sql__warehouse__dir="file:/w", spark__master=master))


def test_in_a_real_session(spark):
    assert spark.conf.get("spark.master").startswith("local[") and shared_dir(spark)
