from types import SimpleNamespace

import pytest
from plait.llm import common


def session(master, path=None):
    conf = {"spark.checkpoint.dir": path} if path else {}
    own = {}
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=conf.get), master=master)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=own.get, set=own.__setitem__))


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs://x/ck/")) == "hdfs://x/ck"


def test_one_process_has_a_private_folder():
    s = session("local[2]")
    assert common.shared_dir(s).startswith("file:///") and common.shared_dir(s) == common.shared_dir(s)


def test_tables_are_written_and_discarded(spark):
    t = common.materialise(spark.range(5), "some")
    assert t.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(t._plait_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path)
    common.discard(t)
    assert not fs.exists(path)
