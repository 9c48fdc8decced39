from __future__ import annotations

from types import SimpleNamespace

import pytest

from curbspark.session import shared_dir


def test_shared_folder_is_the_one_the_session_names(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first.startswith(f"{base}/curbspark/x-") and first != second


def fake(master, conf):
    getter = SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
    return SimpleNamespace(conf=getter, sparkContext=SimpleNamespace(master=master, getConf=lambda: getter))


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077", {}), "x")
    assert shared_dir(fake("yarn", {"spark.checkpoint.dir": "hdfs:///c/"}), "x").startswith("hdfs:///c/curbspark/x-")
