"""A table of folders that readers never see half written.

Data goes to a new folder first. Then a snapshot, the list of all folders that count, is written under the next number; readers take the highest snapshot
that is whole. A batch that runs again publishes its new folder in place of the old one in a single step, and so does compaction, which writes many small
folders again as one. Folders that no snapshot names any more are removed by ``vacuum``, once no reader can be on them. Two writers at once don't lose
each other's folders: a snapshot's file is created only if it isn't there, and who comes second looks again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from citeweave.storage import remove

_WHOLE = "end of snapshot"
#: Old snapshots that stay for readers that have just listed them.
KEPT = 20
#: What a task of ``compact`` writes, so that it holds no more, however large the table.
FILE_BYTES = 32 << 20


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet; False if it is."""
    from py4j.protocol import Py4JJavaError

    fs, at = _file_system(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def snapshot(spark: SparkSession, table: str) -> tuple[int, list[dict]]:
    """Number and folders of the last whole snapshot; each folder has the first and last batch that it holds."""
    for name in reversed(_listed(spark, f"{table}/snapshots")):
        try:
            said = json.loads(_read_text(spark, f"{table}/snapshots/{name}"))
            if said[-1] == _WHOLE:
                return int(name.split(".")[0]), said[:-1]
        except (ValueError, IndexError):
            continue  # still being written
    return 0, []


def _publish(spark: SparkSession, table: str, change) -> list[dict]:
    """Write the next snapshot, ``change`` of the last one's folders; again if another writer was first."""
    number, folders = snapshot(spark, table)
    while True:
        now = change(folders)
        number += 1
        if _create(spark, f"{table}/snapshots/{number:012d}.json", json.dumps([*now, _WHOLE])):
            return now
        number_now, folders = snapshot(spark, table)
        number = max(number, number_now)  # a snapshot that its writer left half written keeps its number


def _written(df: DataFrame, table: str, partition: list[str], first: int, last: int) -> dict:
    folder = f"{table}/data/write={first}-{last}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.parquet(folder)
    return {"folder": folder, "first": first, "last": last}


def publish(df: DataFrame, table: str, batch: int, partition: list[str] = ()) -> None:
    """Write ``df`` as batch number ``batch``; it takes the place of what the batch was before. A batch that has been compacted with others stays as it is."""
    spark = df.sparkSession
    if any(f["first"] <= batch <= f["last"] and f["first"] < f["last"] for f in snapshot(spark, table)[1]):
        return
    new = _written(df, table, list(partition), batch, batch)
    _publish(spark, table, lambda folders: [f for f in folders if not f["first"] <= batch <= f["last"]] + [new])


def read_published(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """What the last snapshot names; no rows if there is none."""
    return _read(spark, table, schema, [f["folder"] for f in snapshot(spark, table)[1]])


def _read(spark: SparkSession, table: str, schema: str, folders: list[str]) -> DataFrame:
    none = spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{table}/data").parquet(*folders).select(*none.columns) if folders else none


def _size(spark: SparkSession, path: str) -> int:
    fs, at = _file_system(spark, path)
    return fs.getContentSummary(at).getLength()


def compact(spark: SparkSession, table: str, schema: str, partition: list[str] = (), keep: int = 0, files: int | None = None) -> int:
    """Write all folders but the last ``keep`` batches again as one, of ``files`` files at most for each partition (None: one for every ``FILE_BYTES``); how many there were."""
    old = sorted(snapshot(spark, table)[1], key=lambda f: f["first"])
    old = old[: len(old) - keep]
    if len(old) < 2:
        return 0
    rows = _read(spark, table, schema, [f["folder"] for f in old])
    files = files or 1 + sum(_size(spark, f["folder"]) for f in old) // FILE_BYTES
    new = _written(rows.coalesce(files), table, list(partition), old[0]["first"], old[-1]["last"])
    gone = {f["folder"] for f in old}

    def change(folders: list[dict]) -> list[dict]:
        if not gone <= {f["folder"] for f in folders}:
            raise RuntimeError("a batch ran again while it was compacted; its folders stay as they are")
        return [f for f in folders if f["folder"] not in gone] + [new]

    _publish(spark, table, change)
    return len(old)


def vacuum(spark: SparkSession, table: str, kept: int = KEPT) -> list[str]:
    """Remove snapshots but the last ``kept`` whole ones, and data folders that none of those names. Only while no batch is being written."""
    names = _listed(spark, f"{table}/snapshots")
    stay, live = [], set()
    for name in reversed(names):
        try:
            said = json.loads(_read_text(spark, f"{table}/snapshots/{name}"))
        except ValueError:
            continue
        if len(stay) < kept and said[-1] == _WHOLE:
            stay.append(name)
            live |= {f["folder"].rsplit("/", 1)[1] for f in said[:-1]}
    gone = [n for n in _listed(spark, f"{table}/data") if n not in live]
    remove(spark, *(f"{table}/snapshots/{n}" for n in names if n not in stay and n < max(stay, default="")), *(f"{table}/data/{n}" for n in gone))
    return gone
