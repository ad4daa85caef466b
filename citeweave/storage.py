"""Folders for intermediate tables: below the one that the cluster shares, and removed when the job is over."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders made outside of any ``scope``, and those of the scope that this thread is in.
_MADE: list[str] = []
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)
#: The temporary folder of each application that runs in one process.
_ALONE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset: a temporary folder of this application if all its tasks run in this process, else one in the warehouse if that is on a file system of its own.

    A warehouse in a ``file:`` folder is on the disc of whoever writes to it, so without a shared folder a cluster gets an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _ALONE:
            _ALONE[app] = tempfile.mkdtemp(prefix="spark-citeweave-")
        return _ALONE[app]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.split(":")[0] in ("file", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/citeweave-scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; the folder goes with the ``scope`` in which it is made."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _SCOPE.get()
    (_MADE if made is None else made).append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """A job: intermediate tables made inside are removed at the end, those of other jobs stay. Results are written or collected inside."""
    made: list[str] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, *made)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: plans stay small, lineage is cut, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders on whatever file system they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete the folders that were made outside of any ``scope``, of whatever job: once all their results have been written or collected."""
    remove(spark, *_MADE)
    _MADE.clear()
