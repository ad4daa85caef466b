"""Published tables and the stream that fills them: restarts, reruns, readers, compaction."""

import json
import os

import pytest

from citeweave.streaming import published
from citeweave.streaming.incremental import DOCUMENTS, PUBLISHED, incremental_resolve
from citeweave.schemas import CANDIDATE, CATALOG

SCHEMA = "k int, route string"


@pytest.fixture
def table(spark, tmp_path):
    return str(tmp_path / "table")


def frame(spark, *keys):
    return spark.createDataFrame([(k, "auto" if k % 2 else "review") for k in keys], SCHEMA)


def keys(spark, table):
    return sorted(r.k for r in published.read_published(spark, table, SCHEMA).collect())


def test_batches_and_reruns(spark, table):
    assert keys(spark, table) == []
    published.publish(frame(spark, 1, 2), table, 0, ["route"])
    published.publish(frame(spark, 3), table, 1, ["route"])
    published.publish(frame(spark, 4, 5), table, 1, ["route"])
    assert keys(spark, table) == [1, 2, 4, 5]
    assert {r.route for r in published.read_published(spark, table, SCHEMA).collect()} == {"auto", "review"}


def test_reader_sees_the_old_batch_until_the_new_one_is_whole(spark, table, monkeypatch):
    published.publish(frame(spark, 1), table, 0)
    seen = []
    create = published._create
    monkeypatch.setattr(published, "_create", lambda *a: (seen.append(keys(spark, table)), create(*a))[1])
    published.publish(frame(spark, 2), table, 0)
    assert seen == [[1]] and keys(spark, table) == [2]
    monkeypatch.setattr(published, "_create", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        published.publish(frame(spark, 3), table, 0)
    assert keys(spark, table) == [2]


def test_half_written_snapshot_is_not_read(spark, table):
    published.publish(frame(spark, 1), table, 0)
    whole = json.dumps([{"folder": "x", "first": 5, "last": 5}, "end of snapshot"])
    for n in range(2, 4):
        with open(f"{table}/snapshots/{n:012d}.json", "w") as f:
            f.write(whole[: len(whole) // n])
    assert keys(spark, table) == [1]
    published.publish(frame(spark, 2), table, 1)
    assert keys(spark, table) == [1, 2]


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    create, first = published._create, []

    def late(*a):
        if not first:
            first.append(1)
            published.publish(frame(spark, 7), table, 7)  # another writer comes between
        return create(*a)

    monkeypatch.setattr(published, "_create", late)
    published.publish(frame(spark, 1), table, 1)
    assert keys(spark, table) == [1, 7]


def test_compaction(spark, table):
    for n in range(5):
        published.publish(frame(spark, n), table, n, ["route"])
    assert published.compact(spark, table, SCHEMA, ["route"], keep=1) == 4 and keys(spark, table) == [0, 1, 2, 3, 4]
    assert [(f["first"], f["last"]) for f in sorted(published.snapshot(spark, table)[1], key=lambda f: f["first"])] == [(0, 3), (4, 4)]
    published.publish(frame(spark, 99), table, 2, ["route"])  # a compacted batch that runs again stays as it is
    assert keys(spark, table) == [0, 1, 2, 3, 4] and published.compact(spark, table, SCHEMA, ["route"], keep=1) == 0
    assert len(published.vacuum(spark, table, kept=1)) == 4 and keys(spark, table) == [0, 1, 2, 3, 4]
    assert len([n for n in os.listdir(f"{table}/snapshots") if n.endswith(".json")]) == 1


def test_document_that_arrives_twice_counts_once(spark, tmp_path):
    inbox, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    entries = spark.createDataFrame([("crossref_doi", "Widget theory", ["A B"], "2000", "10.1000/a.1", "", "", "P")], CATALOG)
    none = spark.createDataFrame([], CANDIDATE)
    for arrived in ([1, 2, 2], [2, 3], [1, 3, 4]):
        rows = [(i, f"/f{i}.pdf", f"Widget theory by A B 10.1000/a.{i} " + "the set of all functions and a space " * 20, "") for i in arrived]
        spark.createDataFrame(rows, DOCUMENTS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", 1).parquet(inbox)
        incremental_resolve(stream, lambda batch: none, entries, sink, mark).awaitTermination()  # starts anew each time
    got = published.read_published(spark, sink, PUBLISHED).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4] and {r.doc_id: r.route for r in got}[1] == "auto"


def test_quarantined_responses(spark, tmp_path):
    from citeweave.sources import files

    rows = spark.createDataFrame([("a", "1", '{"x": 1}'), ("a", "2", '{"x": '), ("a", "3", '{"_error": "no"}'), ("b", "4", "")], "namespace string, key_sha1 string, payload string")
    good, bad = files.checked_responses(rows, str(tmp_path / "aside"))
    assert [r.key_sha1 for r in good.collect()] == ["1"] and sorted(r.line for r in bad.collect()) == ["", '{"x": ']
