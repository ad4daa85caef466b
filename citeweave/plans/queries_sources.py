"""Queries of sources and sinks (A) and of incremental resolution (K1). Replies are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators import reports
from citeweave.operators.lookup import keyed
from citeweave.plans import decide_sql as rules
from citeweave.plans import inputs as src
from citeweave.plans.queries_decide import catalogs, documents
from citeweave.plans.queries_text import _from as from_
from citeweave.plans.queries_text import candidates
from citeweave.plans.registered import ORACLES, query
from citeweave.sources import catalogs as cat
from citeweave.sources import files
from citeweave.storage import scratch
from citeweave.streaming.incremental import DOCUMENTS, PUBLISHED, incremental_resolve, resolved
from citeweave.streaming.published import read_published


def j(sql: str) -> str:
    """A JSON template as concat() for both engines: ~x~ marks an SQL expression."""
    parts = sql.split("~")
    return "concat(" + ", ".join(p if i % 2 else "'" + p.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'" for i, p in enumerate(parts) if p) + ")"


WORKS = "SELECT o_orderkey AS k, " + j(
    '{"message":{"title":["  On  order ~o_orderkey~"],"author":[{"given":"Jo","family":"Stone~o_custkey~"},{"family":"Reed"},{"given":""}],"DOI":"10.1/~o_orderkey~","publisher":"P","published-print":{"date-parts":[[~CASE WHEN o_orderkey % 2 = 0 THEN cast(1990 + o_orderkey % 30 as varchar(9)) ELSE \'\' END~]]},"issued":{"date-parts":[[2001,2]]}}}'
) + " AS payload FROM {orders}"
BOOKS = "SELECT p_partkey AS k, " + j('{"ISBN:~' + src.isbn13("p_partkey") + '~":{"title":"~p_name~","authors":[{"name":"Al ~p_brand~"},{"name":""}],"publish_date":"May ~1950 + p_size~","publishers":[{"name":"~p_type~"}]}}') + " AS payload FROM {part}"
DOCS = "SELECT p_partkey AS k, " + j('{"docs":[{"title":"~p_name~","author_name":["A","B C"],"first_publish_year":~1950 + p_size~,"isbn":["bad","~' + src.isbn13("p_partkey") + '~"]},{"title":""}]}') + " AS payload FROM {part}"
SCHOLAR = "SELECT p_partkey AS k, " + j('{"data":[{"title":"~p_name~","authors":[{"name":"A ~p_brand~"}],"year":~1950 + p_size~,"externalIds":{"DOI":"10.1/~p_partkey~","ArXiv":"2001.0000~p_size % 10~"}}]}') + " AS payload FROM {part}"
ALEX = "SELECT p_partkey AS k, " + j('{"results":[{"display_name":"~CASE WHEN p_size % 2 = 0 THEN p_name ELSE \'\' END~","title":"T ~p_name~","authorships":[{"author":{"display_name":"A"}},{"author":{"display_name":""}}],"publication_year":~1950 + p_size~,"doi":"https://doi.org/10.1/~p_partkey~","primary_location":{"source":{"display_name":"V"}}}]}') + " AS payload FROM {part}"
VOLUMES = "SELECT p_partkey AS k, " + j('{"items":[{"volumeInfo":{"title":"~p_name~","authors":["A"," "],"publishedDate":"~1950 + p_size~-05","publisher":"~p_brand~","industryIdentifiers":[{"identifier":"x"},{"identifier":"~' + src.isbn13("p_partkey") + '~"}]}}]}') + " AS payload FROM {part}"


def _duck(sql: str) -> str:
    """Doubled braces, which stand for literal ones in Spark's templates, as they are meant."""
    masked = sql.replace("{{", "\x01").replace("}}", "\x02")
    return "(" + src.oracle(masked).replace("\x01", "{").replace("\x02", "}") + ") AS t"


def entry_query(name: str, sql: str, function, expected: str):
    @query(name, f"SELECT {expected} FROM {_duck(sql)}")
    def one(spark, sf_dir):
        return function(src.load(spark, sf_dir, sql)).withColumn("authors", F.array_join("authors", "; "))


entry_query(
    "a9_crossref", WORKS, cat.catalog_from_crossref,
    "'crossref_doi' AS source, concat('On order ', k) AS title, concat(json_extract_string(payload, '$.message.author[0].given'), ' ', json_extract_string(payload, '$.message.author[0].family'), '; Reed') AS authors, "
    "coalesce(json_extract_string(payload, '$.message.\"published-print\".\"date-parts\"[0][0]'), '2001') AS year, concat('10.1/', k) AS doi, '' AS isbn, '' AS arxiv, 'P' AS publisher",
)
_X = lambda path: f"json_extract_string(payload, '{path}')"
_IS = src.isbn13("k")
entry_query(
    "a10_openlibrary_books", BOOKS, cat.catalog_from_openlibrary_books,
    f"'openlibrary_isbn' AS source, regexp_extract(payload, '\"title\":\"([^\"]*)\"', 1) AS title, regexp_extract(payload, '\"name\":\"(Al [^\"]*)\"', 1) AS authors, regexp_extract(payload, 'May ([0-9]+)', 1) AS year, '' AS doi, {_IS} AS isbn, '' AS arxiv, regexp_extract(payload, 'publishers\":\\[.\"name\":\"([^\"]*)\"', 1) AS publisher",
)
entry_query(
    "a11_openlibrary_search", DOCS, cat.catalog_from_openlibrary_search,
    f"'openlibrary_search' AS source, {_X('$.docs[0].title')} AS title, 'A; B C' AS authors, {_X('$.docs[0].first_publish_year')} AS year, '' AS doi, {_IS} AS isbn, '' AS arxiv, '' AS publisher",
)
entry_query(
    "a12_semanticscholar", SCHOLAR, cat.catalog_from_semanticscholar,
    f"'semanticscholar_search' AS source, {_X('$.data[0].title')} AS title, {_X('$.data[0].authors[0].name')} AS authors, {_X('$.data[0].year')} AS year, concat('10.1/', k) AS doi, '' AS isbn, {_X('$.data[0].externalIds.ArXiv')} AS arxiv, '' AS publisher",
)
entry_query(
    "a13_openalex", ALEX, cat.catalog_from_openalex,
    f"'openalex_search' AS source, coalesce(nullif({_X('$.results[0].display_name')}, ''), {_X('$.results[0].title')}) AS title, 'A' AS authors, {_X('$.results[0].publication_year')} AS year, concat('10.1/', k) AS doi, '' AS isbn, '' AS arxiv, 'V' AS publisher",
)
entry_query(
    "a14_google_books", VOLUMES, cat.catalog_from_google_books,
    f"'google_books_search' AS source, {_X('$.items[0].volumeInfo.title')} AS title, 'A' AS authors, substr({_X('$.items[0].volumeInfo.publishedDate')}, 1, 4) AS year, '' AS doi, {_IS} AS isbn, '' AS arxiv, {_X('$.items[0].volumeInfo.publisher')} AS publisher",
)


def _chat(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    inner = F.to_json(F.struct(F.substring("text", 1, 40).alias("title"), F.when(F.col("turn") % 2 == 0, F.array(F.col("role"), F.lit(" "))).alias("authors"), F.lit(2001).alias("year"), F.lit("978-0-306-40615-7").alias("isbn")))
    body = F.when(F.col("turn") % 3 == 0, F.struct(F.array(F.struct(F.struct(inner.alias("content")).alias("message"))).alias("choices"), F.lit(None).cast("struct<content:string>").alias("message"))).otherwise(
        F.struct(F.lit(None).cast("array<struct<message:struct<content:string>>>").alias("choices"), F.struct(inner.alias("content")).alias("message"))
    )
    return c.select(F.col("conv_id").alias("doc_id"), "turn", F.to_json(body).alias("payload"), F.lit("m").alias("model"), "text", "role")


@query(
    "a17_llm_candidates",
    "SELECT conv_id AS doc_id, trim(regexp_replace(substr(text, 1, 40), '[\\x00-\\x20\\x7f]+', ' ', 'g')) AS title, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS authors, '2001' AS year, '9780306406157' AS isbn, 'llm:m' AS source, 30 AS priority "
    "FROM conversations WHERE coalesce(trim(regexp_replace(substr(text, 1, 40), '[\\x00-\\x20\\x7f]+', ' ', 'g')), '') <> '' OR (turn % 2 = 0 AND role <> '')",
)
def a17(spark, sf_dir):
    out = cat.candidates_from_llm_json(_chat(spark, sf_dir))
    return out.select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "isbn", "source", "priority")


@query("a18_usable_replies", "SELECT conv_id AS doc_id, count(*) AS n FROM conversations WHERE turn % 3 = 0 AND (coalesce(trim(substr(text, 1, 40)), '') <> '' OR turn % 2 = 0) GROUP BY 1")
def a18(spark, sf_dir):
    return cat.llm_response_usable(_chat(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "a19_embedded_info",
    "SELECT p_partkey AS doc_id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS title, concat('Ann ', p_brand) AS authors, cast(1950 + p_size AS varchar) AS year, 'pdfinfo' AS source FROM part",
)
def a19(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    info = F.concat(F.lit("Title: "), F.when(F.col("p_size") % 5 == 0, F.lit("Untitled.tex")).otherwise(F.col("p_name")), F.lit("\nAuthor:  Ann "), "p_brand", F.lit("\nPages 3\nCreationDate: May "), (F.col("p_size") + 1950).cast("string"))
    out = cat.candidates_from_pdfinfo(p.select(F.col("p_partkey").alias("doc_id"), info.alias("info")))
    return out.select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "source")


@query(
    "a15_arxiv_atom",
    "SELECT 'arxiv_id' AS source, concat('On order ', o_orderkey) AS title, 'Jo Stone' AS authors, cast(extract(year FROM o_orderdate) AS varchar) AS year, concat('10.1000/x', o_orderkey) AS doi, '' AS isbn, concat('2001.', lpad(cast(o_orderkey AS varchar), 5, '0')) AS arxiv, '' AS publisher FROM orders",
)
def a15(spark, sf_dir):
    o = src.to_all_tasks(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate"), "o_orderkey")
    feed = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>q</title><entry><title>On  order '), F.col("o_orderkey").cast("string"), F.lit("</title><author><name>Jo Stone</name></author><author><name> </name></author><published>"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</published><summary>see 10.1000/x"), F.col("o_orderkey").cast("string"), F.lit(" &amp; more</summary></entry></feed>"),
    )
    out = cat.catalog_from_arxiv_atom(o.select(feed.alias("payload"), F.concat(F.lit("2001."), F.lpad(F.col("o_orderkey").cast("string"), 5, "0")).alias("arxiv")))
    return out.withColumn("authors", F.array_join("authors", "; "))


@query("a16_tei_candidates", "SELECT o_orderkey AS doc_id, concat('On order ', o_orderkey, ' of widgets') AS title, 'Jo Stone' AS authors, 'grobid' AS source, 12 AS priority FROM orders")
def a16(spark, sf_dir):
    o = src.to_all_tasks(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey")
    tei = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On order '), F.col("o_orderkey").cast("string"), F.lit(" of widgets</title></titleStmt><sourceDesc><author><persName><forename>Jo</forename><surname>Stone</surname></persName></author></sourceDesc></fileDesc></teiHeader></TEI>"),
    )
    out = cat.candidates_from_tei(o.select(F.col("o_orderkey").alias("doc_id"), tei.alias("payload")))
    return out.select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "source", "priority")


@query(
    "a3_routes",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'auto' WHEN o_orderkey % 3 = 1 THEN 'auto,soft' ELSE 'review' END AS route, printf('%.3f', o_totalprice / 1000000) AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END AS safe FROM orders",
)
def a3(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.expr("cast(array() as array<string>)")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("doc_id"), F.concat(F.lit("/lib/"), k.cast("string")).alias("path"), none.alias("tags"), none.alias("authors"), none.alias("notes"), none.alias("soft_auto_reasons"), (F.col("o_totalprice") / 1000000).alias("sanity_score"),
        (k % 3 == 0).alias("auto_safe"), (k % 3 == 1).alias("soft_auto"), F.lit("x").alias("source"),
    )
    routed = rows.withColumn("route", F.array_join(files.routes(F.col("auto_safe"), F.col("soft_auto")), ","))
    return files.result_rows(routed, ["doc_id", "route"]).select("doc_id", "route", F.col("Sanity Score").alias("score"), F.col("Auto Safe").alias("safe"))


@query(
    "a3_written_tables",
    "WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 AS m FROM orders) SELECT 'auto' AS route, concat('/lib/', k) AS path, CASE WHEN m = 0 THEN 'yes' ELSE 'no' END AS safe, CASE WHEN m = 1 THEN 'yes' ELSE 'no' END AS soft, 'A; \"B\"' AS authors FROM r WHERE m < 2 "
    "UNION ALL SELECT 'soft', concat('/lib/', k), 'no', 'yes', 'A; \"B\"' FROM r WHERE m = 1 UNION ALL SELECT 'review', concat('/lib/', k), 'no', 'no', 'A; \"B\"' FROM r WHERE m = 2",
)
def a3_written(spark, sf_dir):
    k, folder = F.col("o_orderkey"), scratch(spark, "routed")
    none = F.expr("cast(array() as array<string>)")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("/lib/"), k.cast("string")).alias("path"), none.alias("tags"), F.array(F.lit("A"), F.lit('"B"')).alias("authors"), none.alias("notes"), none.alias("soft_auto_reasons"), F.lit(0.5).alias("sanity_score"),
        (k % 3 == 0).alias("auto_safe"), (k % 3 == 1).alias("soft_auto"), F.lit("x").alias("source"),
    )
    files.write_routed(rows, folder)
    tables = [files.read_results(spark, f"{folder}/route={r}").select(F.lit(r).alias("route"), F.col("File Path").alias("path"), F.col("Auto Safe").alias("safe"), F.col("Soft Auto").alias("soft"), F.col("Authors").alias("authors")) for r in ("auto", "soft", "review")]
    return tables[0].union(tables[1]).union(tables[2])


@query("a1_list_documents", "SELECT DISTINCT cast(n_regionkey AS varchar) AS folder FROM nation ORDER BY 1 LIMIT 3 OFFSET 1")
def a1(spark, sf_dir):
    """A file a region, listed by path: the first left out, three taken."""
    folder = scratch(spark, "files")
    spark.read.parquet(f"{sf_dir}/nation.parquet").repartition(1).write.partitionBy("n_regionkey").parquet(folder)
    return files.list_documents(spark, folder, 1, 3, "*.parquet").select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).alias("folder"))


@query("a7_read_responses", "SELECT concat('namespace=n', s_nationkey % 3) AS namespace, cast(s_suppkey AS varchar) AS k, s_name AS name, true AS keyed FROM supplier")
def a7(spark, sf_dir):
    """A file a supplier in three folders, read back as responses."""
    folder = scratch(spark, "responses")
    rows = src.to_all_tasks(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey").select(F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string")).alias("namespace"), F.col("s_suppkey").alias("k"), "s_name")
    rows.write.option("maxRecordsPerFile", 1).partitionBy("namespace").json(folder)
    got = files.read_responses(spark, folder)
    return got.select("namespace", F.get_json_object("payload", "$.k").alias("k"), F.get_json_object("payload", "$.s_name").alias("name"), (F.length("key_sha1") > 0).alias("keyed"))


@query(
    "a2_read_results",
    f"SELECT regexp_extract(\"File Path\", '([^/]*)$', 1) AS file, \"Title\" AS title, \"Authors\" AS authors, \"Error\" AS error FROM {from_(src.RESULTS)}",
)
def a2(spark, sf_dir):
    folder = scratch(spark, "results")
    reports_rows = src.load(spark, sf_dir, src.RESULTS).drop("seq")
    reports_rows.write.csv(folder, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    return files.read_results(spark, folder).select(F.regexp_extract("File Path", "([^/]*)\\z", 1).alias("file"), F.col("Title").alias("title"), F.col("Authors").alias("authors"), F.col("Error").alias("error"))


#: Lines of a result table as they might be found: some cut short, some with a cell too many.
_LINE = "concat_ws(chr(9), concat('/lib/f', cast(o_orderkey as varchar(20)), '.pdf'), 'tag', 'crossref_doi', CASE o_orderkey % 3 WHEN 0 THEN 'high' ELSE 'low' END, CASE WHEN o_orderkey % 4 < 2 THEN 'yes' ELSE 'no' END, concat('On order ', cast(o_orderkey as varchar(20))), 'Jo Stone', '2001', '', '', '', 'yes', '0.500', CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END, 'no', '', 'no', '', '', 'no', '', '', '', 'crossref_doi', 'no', '')"
LINES = f"SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN substr({_LINE}, 1, 20) WHEN o_orderkey % 23 = 0 THEN concat({_LINE}, chr(9), 'more') ELSE {_LINE} END AS line FROM {{orders}}"
_BAD = "(o_orderkey % 17 = 0 OR o_orderkey % 23 = 0)"


@query(
    "a2_i1_quarantine",
    f"SELECT count_if(NOT {_BAD}) AS total, count_if(NOT {_BAD} AND o_orderkey % 2 = 0) AS auto_safe, 0 AS soft_auto, count_if(NOT {_BAD} AND o_orderkey % 2 = 1) AS review, count_if(NOT {_BAD} AND o_orderkey % 3 = 0) AS high, 0 AS medium, count_if(NOT {_BAD} AND o_orderkey % 3 <> 0) AS low, "
    f"count_if(NOT {_BAD} AND o_orderkey % 4 < 2) AS verified, count_if(NOT {_BAD}) AS sanity_passed, 0 AS needs_ocr, 0 AS imported, count_if({_BAD}) AS unreadable FROM orders",
)
def a2_bad(spark, sf_dir):
    folder, aside = scratch(spark, "results"), scratch(spark, "results-quarantine")
    src.load(spark, sf_dir, LINES).select("line").write.text(folder)
    good, bad = files.read_checked_results(spark, folder, aside, header=False)
    return reports.run_summary(reports.flagged(good), bad)


_JSON_LINE = "concat(chr(123), '\"file_path\":\"/lib/f', cast(o_orderkey as varchar(20)), '.pdf\",\"error\":\"', CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' ELSE '' END, '\",\"imported\":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, chr(125))"
JSON_LINES = f"SELECT CASE WHEN o_orderkey % 19 = 0 THEN substr({_JSON_LINE}, 1, 25) ELSE {_JSON_LINE} END AS value FROM {{orders}}"


@query(
    "a5_quarantine",
    "SELECT 'kept' AS what, count_if(o_orderkey % 19 <> 0) AS n, count_if(o_orderkey % 19 <> 0 AND o_orderkey % 5 = 0) AS with_error FROM orders UNION ALL SELECT 'quarantined', count_if(o_orderkey % 19 = 0), 0 FROM orders",
)
def a5_bad(spark, sf_dir):
    folder, aside = scratch(spark, "debug"), scratch(spark, "debug-quarantine")
    src.load(spark, sf_dir, JSON_LINES).write.text(folder)
    good, bad = files.read_checked_debug(spark, folder, aside)
    kept = files.flatten_debug(good).agg(F.count("*").alias("n"), F.count_if(F.col("Error") != "").alias("with_error")).select(F.lit("kept").alias("what"), "n", "with_error")
    return kept.union(bad.agg(F.count("*")).select(F.lit("quarantined"), "count(1)", F.lit(0).cast("long")))


@query(
    "a4_profile_rows",
    "SELECT event_id, printf('%.6f', value) AS crossref_s, cast(user_id % 4 AS varchar) AS crossref_tried, '0.000000' AS openalex_s, '2' AS lookups FROM events",
)
def a4(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = lambda tried: F.struct(F.lit("crossref").alias("source"), F.col("value").alias("elapsed_s"), tried.cast("int").alias("candidates_tried"), F.lit(1).alias("matches_returned"), F.lit(0).alias("errors"))
    look = F.struct(F.lit("doi").alias("kind"), F.lit("10.1/x").alias("value"))
    t = e.select("event_id", F.array(look, look).alias("lookups"), F.array(one(F.lit(9)), one(F.col("user_id") % 4)).alias("searches"))
    p = files.profile_rows(t)
    return p.select("event_id", F.col("Crossref Search s").alias("crossref_s"), F.col("Crossref Search Candidates Tried").alias("crossref_tried"), F.col("OpenAlex Search s").alias("openalex_s"), F.col("Identifier Lookup Count").alias("lookups"))


@query(
    "a5_flatten_debug",
    "SELECT concat('/lib/', o_orderkey) AS path, 'a, b' AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS verified, 'grobid' AS local_best, '' AS grobid_title FROM orders",
)
def a5(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("/lib/"), k.cast("string")).alias("file_path"), F.array(F.lit("a"), F.lit("b")).alias("tags"), F.struct(F.lit("T").alias("title"), (k % 2 == 0).alias("verified")).alias("result"),
        F.create_map(F.lit("local_best_source"), F.lit(" grobid ")).alias("debug"),
    )
    folder = scratch(spark, "debug")
    files.write_debug_json(rows, folder)
    flat = files.flatten_debug(files.read_debug_json(spark, folder))
    return flat.select(F.col("File Path").alias("path"), F.col("Tags").alias("tags"), F.col("Verified").alias("verified"), F.col("Local Best Source").alias("local_best"), F.col("GROBID Title").alias("grobid_title"))


@query(
    "a6_page_windows",
    "WITH p AS (SELECT conv_id, turn + 1 AS n, concat('p', turn) AS t FROM conversations) SELECT conv_id AS doc_id, coalesce(string_agg(t, chr(10) ORDER BY n) FILTER (WHERE n <= 2), '') AS text, string_agg(t, chr(10) ORDER BY n) FILTER (WHERE n <= 8) AS ident_text FROM p WHERE n <= 8 GROUP BY 1",
)
def a6(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("text"))
    return files.page_windows(pages).select("doc_id", "text", "ident_text")


RESPONSES = (
    "SELECT event_id, event_type AS namespace, CASE event_id % 6 WHEN 0 THEN " + j('{"_error":"x"}') + " WHEN 1 THEN " + j('{"_text":""}') + " WHEN 2 THEN " + j('{"_http_error":~CASE WHEN user_id % 2 = 0 THEN \'404\' ELSE \'503\' END~}')
    + " WHEN 3 THEN 'not json' WHEN 4 THEN '[1]' ELSE " + j('{"a":~user_id~}') + " END AS payload, user_id FROM {events}"
)


@query("a8_purged", f"SELECT event_id FROM {_duck(RESPONSES)} WHERE event_id % 6 IN (4, 5) OR (event_id % 6 = 2 AND user_id % 2 = 0)")
def a8(spark, sf_dir):
    return files.purge_errors(src.load(spark, sf_dir, RESPONSES)).select("event_id")


@query("a8_valid", f"SELECT event_id FROM {_duck(RESPONSES)} WHERE event_id % 6 IN (1, 4, 5) OR (event_id % 6 = 2 AND user_id % 2 = 0)")
def a8_valid(spark, sf_dir):
    return files.valid_responses(src.load(spark, sf_dir, RESPONSES)).select("event_id")


@query("i10_response_counts", "SELECT event_type AS namespace, count(*) AS n FROM events GROUP BY 1")
def i10(spark, sf_dir):
    return reports.response_counts(src.load(spark, sf_dir, RESPONSES))


@query(
    "k1_incremental_resolve",
    rules.based("SELECT doc_id, coalesce(source, '') AS source, coalesce(title, '') AS title, coalesce(sanity_score, 0.0) AS sanity_score, CASE WHEN coalesce(sanity_passed, false) THEN 'auto' ELSE 'review' END AS route FROM m LEFT JOIN best USING (doc_id)"),
)
def k1(spark, sf_dir):
    inbox, sink, mark = (scratch(spark, f"k1-{x}") for x in ("in", "out", "mark"))
    docs = src.to_all_tasks(documents(spark, sf_dir).select("doc_id", "path", "text", "ident_text"), "doc_id")
    docs.write.parquet(inbox)
    half = (docs.rdd.getNumPartitions() + 1) // 2  # two batches, whatever the number of files
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", half).parquet(inbox)
    entries, cands = catalogs(spark, sf_dir), candidates(spark, sf_dir)
    run = incremental_resolve(stream, lambda batch: cands.join(batch.select("doc_id"), "doc_id", "left_semi"), entries, sink, mark)
    run.awaitTermination()
    return read_published(spark, sink, PUBLISHED)


@query("k1_repeated_documents", ORACLES["k1_incremental_resolve"])
def k1_repeated(spark, sf_dir):
    """Every document arrives twice, the second time after a restart, together with those that are new; batches are compacted."""
    inbox, sink, mark = (scratch(spark, f"k1-{x}") for x in ("in", "out", "mark"))
    docs = documents(spark, sf_dir).select("doc_id", "path", "text", "ident_text")
    entries, cands = keyed(catalogs(spark, sf_dir)), candidates(spark, sf_dir)
    for part in (docs.filter("doc_id % 3 = 0"), docs, docs.filter("doc_id % 2 = 0")):
        part.write.mode("append").parquet(inbox)  # by all tasks; an arrival is one batch
        stream = spark.readStream.schema(DOCUMENTS).parquet(inbox)
        incremental_resolve(stream, lambda batch: cands.join(batch.select("doc_id"), "doc_id", "left_semi"), entries, sink, mark, compact_every=2).awaitTermination()
    return read_published(spark, sink, PUBLISHED)


def k1_batch(spark, sf_dir) -> DataFrame:
    """What K1 must equal."""
    return resolved(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir))
