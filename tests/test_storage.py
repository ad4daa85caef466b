"""Folders of intermediate tables."""

import os

import pytest

from citeweave import storage


def test_scope_removes_its_own_folders_only(spark):
    outside = storage.stash(spark.range(3), "outside")
    with storage.scope(spark):
        inside = storage.scratch(spark, "inside")
        spark.range(5).write.parquet(inside)
        with storage.scope(spark):
            deeper = storage.scratch(spark, "deeper")
            spark.range(5).write.parquet(deeper)
        assert os.path.isdir(inside.removeprefix("file:")) and not os.path.exists(deeper.removeprefix("file:"))
    assert not os.path.exists(inside.removeprefix("file:")) and outside.count() == 3
    with pytest.raises(ZeroDivisionError), storage.scope(spark):
        storage.stash(spark.range(1), "failed")
        1 / 0


class Context:
    applicationId = "app-of-the-test"

    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}


class Session:
    def __init__(self, master, **conf):
        self.sparkContext, self.conf = Context(master), conf


def test_a_cluster_needs_a_shared_folder():
    named = {"spark.sql.warehouse.dir": "file:/somewhere/spark-warehouse"}
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_folder(Session(master, **named))
        with pytest.raises(ValueError):
            storage.shared_folder(Session(master, **{"spark.sql.warehouse.dir": "/plain/path"}))
    assert storage.shared_folder(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/w/"})) == "hdfs://n/w/citeweave-scratch"
    assert storage.shared_folder(Session("yarn", **named, **{"spark.checkpoint.dir": "hdfs://n/c"})) == "hdfs://n/c"


def test_one_process_uses_one_temporary_folder():
    alone = Session("local[2]", **{"spark.sql.warehouse.dir": "file:/w"})
    folder = storage.shared_folder(alone)
    assert os.path.isdir(folder) and storage.shared_folder(alone) == folder and "spark.checkpoint.dir" not in alone.conf
