"""Where checkpoints go."""

from types import SimpleNamespace

import pytest

from quire.session import checkpoint_dir


def _session(master, folder=None):
    made = []
    conf = SimpleNamespace(get=lambda *a: folder)
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None,
                         setCheckpointDir=made.append, getConf=lambda: conf)
    return SimpleNamespace(sparkContext=sc, conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_session(master))
    assert checkpoint_dir(_session(master, "hdfs:///shared")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_process_gets_a_scratch_folder(master):
    assert checkpoint_dir(_session(master))
