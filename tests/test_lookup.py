"""The keyed catalog: Bloom filter, buckets, updates."""

import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import lookup, reduce
from citeweave.schemas import CATALOG


def catalog(spark, n, title="Work {}"):
    return spark.createDataFrame([("crossref_doi", title.format(i), ["A B"], "2000", f"10.1000/C.{i}", "", "", "P") for i in range(n)], CATALOG)


def pool(spark, keys):
    return spark.createDataFrame([(i, "doi", 0, f"10.1000/c.{k}") for i, k in enumerate(keys)], "doc_id long, kind string, pos int, value string")


def test_filter_keeps_what_is_asked_for(spark):
    rows = spark.range(20_000).select((F.col("id") % 10_000).alias("k"), F.lit("x").alias("kind"), "id")
    wanted = spark.range(0, 10_000, 100).select(F.col("id").alias("k"), F.lit("x").alias("kind"))
    got = reduce.asked_for(rows, wanted, ["kind", "k"])
    assert got.columns == rows.columns and got.filter("k % 100 = 0").count() == 200 and got.count() < 200 + 20_000 // 8
    assert reduce.asked_for(rows, wanted.limit(0), ["kind", "k"]).count() < 1_000


def test_filter_gives_up_where_it_would_be_full(spark, monkeypatch):
    monkeypatch.setattr(reduce, "WORDS_MOST", 1)
    rows = spark.range(1_000).select(F.col("id").alias("k"))
    assert reduce.filter_words(rows, ["k"]) is None and reduce.asked_for(rows, rows, ["k"]).count() == 1_000


def test_lookup_shuffles_what_is_wanted(spark):
    entries = catalog(spark, 5_000)
    got = lookup.lookup_identifiers(pool(spark, [3, 4_999, 9_999]), entries)
    assert {(r.doc_id, r.matched, r.title) for r in got.collect()} == {(0, True, "Work 3"), (1, True, "Work 4999"), (2, False, None)}
    wanted = pool(spark, [3, 4_999, 9_999]).select("kind", F.lower("value").alias("key"))
    assert lookup.catalog_keys(entries, wanted).count() < 1_000


def test_first_arrival_wins(spark):
    both = catalog(spark, 2, "Z {}").withColumn("arrival", F.lit(1)).union(catalog(spark, 2, "A {}").withColumn("arrival", F.lit(2)))
    assert {r.entry.title for r in lookup.catalog_keys(both).collect()} == {"Z 0", "Z 1"}
    assert {r.entry.title for r in lookup.catalog_keys(both.drop("arrival")).collect()} == {"A 0", "A 1"}


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def table(spark):
    names = ["kept_catalog", "kept_catalog_2"]
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")
    yield names
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_bucketed_catalog_is_not_shuffled(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = lookup.write_keyed(catalog(spark, 300), table[0], 4)
        found = lookup.lookup_identifiers(pool(spark, range(0, 600, 2)), kept)
        assert len(exchanges(found)) == 1 and found.filter("matched").count() == 150
        newer = lookup.update_keyed(table[0], catalog(spark, 10, "Newer {}").union(catalog(spark, 400, "Late {}").filter("title IN ('Late 350', 'Late 399')")), table[1], 4)
        entries = {r.key: r.entry.title for r in newer.collect()}
        assert entries["10.1000/c.5"] == "Newer 5" and entries["10.1000/c.299"] == "Work 299" and entries["10.1000/c.350"] == "Late 350"
        assert len(exchanges(lookup.lookup_identifiers(pool(spark, [1]), newer))) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_is_broadcast_in_few_rows(spark):
    """A row of the broadcast holds a block of words, those without a bit too; no key is lost at its seams."""
    wanted = spark.range(0, 300_000, 3).withColumnRenamed("id", "k")
    words, bits = reduce.filter_words(wanted, ["k"])
    sizes = [r.n for r in words.selectExpr("size(__sets) AS n").collect()]
    assert sizes == [reduce.BLOCK] * (bits // 64 // reduce.BLOCK) and len(sizes) == 32
    kept = reduce.asked_for(spark.range(300_000).withColumnRenamed("id", "k"), wanted, ["k"])
    assert kept.join(wanted, "k").count() == 100_000 and kept.count() < 120_000
