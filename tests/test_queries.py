"""Registered queries against their DuckDB counterparts on the smallest tables; streaming against batch."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from citeweave.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(rows):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, got.select(*columns).collect())) == plain(tuple(r[i] for i in order) for r in want.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_its_counterpart():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("module", ["queries_text", "queries_decide", "queries_sources", "queries_reports", "registry"])
def test_modules_of_queries_can_be_imported_first(module):
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", f"import citeweave.plans.{module}"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_stream_equals_batch(spark, sf):
    from citeweave.plans.queries_sources import k1_batch

    got = registry.QUERIES["k1_incremental_resolve"](spark, sf)
    assert plain(map(tuple, got.collect())) == plain(map(tuple, k1_batch(spark, sf).collect()))


def test_title_search_by_words_and_by_spelling(spark, sf):
    """Words alone find fewer of the misspelt titles; the way of the jobs finds nine tenths at least of what the exact way finds, and nothing else."""
    from citeweave.operators import search
    from citeweave.plans.queries_decide import title_tables

    tables = title_tables(spark, sf)
    by_word, job, exact = ({(r.qid, r.source) for r in search.title_search(*tables, spelling=s).collect()} for s in (False, "rest", True))
    assert by_word < job <= exact and len(job) >= 0.9 * len(exact)


def test_title_search_with_hot_words(spark, sf):
    """Where all words count as hot, second words and lengths stand in for them: every pair with a word Jaccard of 0.8 is there."""
    from citeweave.functions.similarity import word_jaccard
    from citeweave.functions.text import normalize_title
    from citeweave.operators import search
    from citeweave.plans.queries_decide import title_tables

    q, k = title_tables(spark, sf)
    extra = spark.createDataFrame([(10**6 + i, t, []) for i, t in enumerate(["theory", "the theory", "the theory of it", "a"])], "id long, title string, authors array<string>")
    q = q.select("qid", "title").union(extra.selectExpr("id", "title"))
    k = k.select("eid", "title").union(extra.selectExpr("id", "concat(title, '!')"))
    norm = lambda df, key, name: df.select(key, normalize_title(F.col("title")).alias(name))
    every = norm(q, "qid", "a").crossJoin(norm(k, "eid", "b")).filter(word_jaccard(F.col("a"), F.col("b")) >= 0.8)
    want = {(r.qid, r.eid) for r in every.collect()}
    got = {(r.qid, r.eid) for r in search.blocked_pairs(q, k, hot=0).collect()}
    assert len(want) > 20 and want <= got and len(got) < 3 * len(want)


def test_spelling_with_hot_runs(spark):
    """Runs that many titles have give way to longer ones: misspelt twins are found, titles of one pattern don't all meet; blank and very short titles do no harm."""
    from citeweave.operators import search

    names = ["".join(chr(97 + (k * 7919 + 31) * p % 9973 % 26) for p in (3, 17, 101, 443, 1009, 2003, 3001, 4001, 5003)) for k in range(120)]
    title = lambda name: f"proceedings of the annual workshop on {name} held in {name[::-1]} and its proofs"
    entries = [(n, title(name), [], "") for n, name in enumerate(names)] + [(500 + n, "abc", [], "") for n in range(5)] + [(600, "", [], ""), (601, None, [], "")]
    misspelt = [(n, title(name).replace("proceedings", "procedings").replace("proofs", "profs"), [], "") for n, name in enumerate(names)]
    asked = [*misspelt, (500, "abc", [], ""), (600, "", [], ""), (601, None, [], ""), (602, "ab", [], "")]
    shape = "{} long, title string, authors array<string>, year string"
    q, k = spark.createDataFrame(asked, shape.format("qid")), spark.createDataFrame(entries, shape.format("eid"))
    exact, bounded = ({(r.qid, r.eid) for r in search.spelled_pairs(q, k, hot=h).collect()} for h in (None, 20))
    assert {(n, n) for n in range(120)} | {(500, 500 + n) for n in range(5)} <= bounded <= exact
    assert len(exact) > 10_000 and len(bounded) < len(exact) / 4 and not {600, 601} & {x for pair in bounded for x in pair}


def test_inputs_grow_with_their_tables(spark):
    """Every sixth order has an arXiv entry and id of its own, and orders cite all parts."""
    from citeweave.plans import inputs

    orders = spark.range(0, 130_000, 131).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "date'2000-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    part = spark.range(300).selectExpr("id AS p_partkey", "'n' AS p_name", "'T' AS p_type", "'b' AS p_brand")
    made = lambda sql: spark.sql(sql, orders=orders, part=part)
    entries = made(inputs.CATALOG).filter("source = 'arxiv_id'")
    assert entries.count() == entries.select("arxiv").distinct().count() == sum(k % 6 == 1 for k in range(0, 130_000, 131))
    docs = made(inputs.MENTIONS)
    assert docs.count() == 993
    assert docs.selectExpr("regexp_extract(text, 'ISBN (978[0-9]+) of', 1) AS isbn").filter("isbn <> ''").distinct().count() == 75
    cited = docs.selectExpr("regexp_extract(text, 'arXiv: ([0-9.]{10}) end', 1) AS arxiv").filter("arxiv <> ''")
    assert cited.join(entries, "arxiv").count() == entries.count()


def test_soft_audit_queue_by_final_source(spark, tmp_path):
    """Equal rows but for Source come in their order; the operator itself falls back on Source where Final Source is blank."""
    from citeweave.operators import reports
    from citeweave.plans import queries_reports

    orders = spark.range(1, 4000, 6).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "CASE WHEN id % 4 = 1 THEN 'O' ELSE 'F' END AS o_orderstatus", "date'2000-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority", "1.0D AS o_totalprice")
    orders.selectExpr("* EXCEPT (o_orderkey)", "o_orderkey * 1000 + 3 AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.seq for r in queries_reports.g11(spark, str(tmp_path)).orderBy("soft_id").collect()]
    rows = {r.seq: r for r in queries_reports.joined(spark, str(tmp_path)).collect()}
    assert len(got) == 100 and len({rows[k]["Source"] for k in got}) > 1
    key = lambda r: (r["Needs OCR"] != "yes", r["Sanity Passed"] == "yes", float(r["Sanity Score"]), r["DOI"] != "", r["Final Source"] not in reports.RISKY_SOURCES, len(r["Title"].split()), r["Authors"].count(";"), r.seq)
    assert got == [r.seq for r in sorted((r for r in rows.values() if r["Soft Auto"] == "yes"), key=key)[:100]]
    full = reports.soft_audit_queue(queries_reports.joined(spark, str(tmp_path)).withColumn("missing", reports.F.lit(False)), 100)
    assert [r.seq for r in full.orderBy("Soft ID").collect()] != got


def test_text_is_made_by_all_tasks(spark, tmp_path):
    """A table in one small file doesn't leave the work on its texts to one task."""
    from citeweave.plans import queries_sources, queries_text

    spark.range(40).selectExpr("id AS p_partkey", "'wood' AS p_name", "'b' AS p_brand", "'T' AS p_type", "cast(id AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert queries_text.e1(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    spark.range(40).selectExpr("id AS o_orderkey", "date'2000-01-01' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert all(q(spark, str(tmp_path)).rdd.getNumPartitions() > 1 for q in (queries_sources.a15, queries_sources.a16))


def test_titles_of_names_are_cut_once(spark):
    """Layouts name the cut title often; its patterns stand in the plan once for each place where a name is cut."""
    from citeweave.functions import text as tx
    from citeweave.operators import extract

    names = spark.createDataFrame([(1, "/a/b.pdf")], "doc_id long, path string")
    plan = extract.candidates_from_filename(names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(tx.CLOSED_YEAR) <= 4
