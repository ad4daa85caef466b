"""Queries of lookup, search, selection and decision rules (F5-F8, G, H) and of the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import identifiers as ids
from citeweave.functions import quality

from citeweave.operators import candidates as cands
from citeweave.operators import decide, lookup, search
from citeweave.operators.candidates import identifier_pool
from citeweave.plans import decide_sql as rules
from citeweave.plans import ducksql as d
from citeweave.plans import inputs as src
from citeweave.plans import jobs, phases
from citeweave.plans.queries_text import MENTION_SQL, candidates, mentions, with_windows
from citeweave.plans.queries_text import _from as from_
from citeweave.plans.registered import ORACLES, query
from citeweave.storage import stash


def documents(spark, sf_dir) -> DataFrame:
    return with_windows(mentions(spark, sf_dir))


def catalogs(spark, sf_dir) -> DataFrame:
    return src.load(spark, sf_dir, src.CATALOG, {"orders": "o_orderkey"}).withColumn("authors", F.split("authors", "; "))


def search_catalog(spark, sf_dir) -> DataFrame:
    """The catalog again as search sources, numbered."""
    to_search = F.when(F.col("source") == "crossref_doi", F.when(F.length("title") % 2 == 0, "crossref_search").otherwise("openalex_search")).when(F.col("source") == "openlibrary_isbn", "openlibrary_search").otherwise("semanticscholar_search")
    return catalogs(spark, sf_dir).withColumn("eid", F.xxhash64("source", "title", "doi", "isbn", "arxiv")).withColumn("source", to_search)


_CAT = f"(SELECT *, CASE source WHEN 'crossref_doi' THEN 'doi' WHEN 'openlibrary_isbn' THEN 'isbn' ELSE 'arxiv' END AS kind, CASE source WHEN 'crossref_doi' THEN lower(doi) WHEN 'openlibrary_isbn' THEN isbn ELSE arxiv END AS key FROM {from_(src.CATALOG)})"
_C8 = ORACLES["c8_identifier_pool"]
_HITS = f"SELECT p.doc_id, p.kind, p.value, c.title, c.authors, c.source, c.year FROM ({_C8}) p JOIN {_CAT} c ON c.kind = p.kind AND c.key = CASE WHEN p.kind = 'doi' THEN lower(p.value) ELSE p.value END"


@query(
    "f5_lookup_identifiers",
    f"SELECT p.doc_id, p.kind, p.value, c.key IS NOT NULL AS matched, coalesce(c.title, '') AS title FROM ({_C8}) p LEFT JOIN {_CAT} c ON c.kind = p.kind AND c.key = CASE WHEN p.kind = 'doi' THEN lower(p.value) ELSE p.value END WHERE p.kind <> 'stable'",
)
def f5(spark, sf_dir):
    pool = identifier_pool(documents(spark, sf_dir), candidates(spark, sf_dir))
    return lookup.lookup_identifiers(pool, catalogs(spark, sf_dir)).select("doc_id", "kind", "value", "matched", F.coalesce("title", F.lit("")).alias("title"))


_FEATURES = f"SELECT doc_id, {d.sanity('substr(text, 1, 8000)')} AS norm, {d.words(d.filename('path'))} AS name_words, length({d.strip('text')}) < 100 AS short, {d.unreadable('text')} AS blind FROM {MENTION_SQL}"
_SCORE = d.sanity_score("h.title", d.split_names("h.authors"), "h.source", "f.norm", "f.name_words", "f.short", "f.blind")
_SCORED = f"SELECT h.*, round({_SCORE}, 3) AS sanity_score FROM ({_HITS}) h JOIN ({_FEATURES}) f USING (doc_id)"


@query("g1_g2_sanity", f"SELECT doc_id, kind, value, sanity_score, sanity_score >= 0.4 AS sanity_passed FROM ({_SCORED})")
def g1(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = lookup.scored_hits(lookup.lookup_identifiers(identifier_pool(docs, candidates(spark, sf_dir)), catalogs(spark, sf_dir)), jobs.features(docs))
    return hits.select("doc_id", "kind", "value", "sanity_score", "sanity_passed")


_BEST = "SELECT doc_id, sanity_passed FROM best"


@query("f6_best_identifier", rules.based("SELECT doc_id, kind, value, title, array_to_string(names, '; ') AS authors, year, doi, isbn, arxiv, source, publisher, sanity_score, sanity_passed FROM best"))
def f6(spark, sf_dir):
    best = jobs.identifier_resolution(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir))
    return best.select("doc_id", "kind", "value", "title", F.array_join("authors", "; ").alias("authors"), "year", "doi", "isbn", "arxiv", "source", "publisher", "sanity_score", "sanity_passed")


@query("w1_identifier_resolution", rules.based("SELECT doc_id, title, source, sanity_score, sanity_passed AS auto_safe, CASE WHEN sanity_passed THEN 'auto' ELSE 'review' END AS route FROM best"))
def w1(spark, sf_dir):
    return jobs.identifier_resolution(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir)).select("doc_id", "title", "source", "sanity_score", "auto_safe", "route")


def _named(sql: str) -> str:
    return f"(SELECT *, {d.split_names('authors')} AS names FROM ({src.oracle(sql)}) AS t)"


def title_tables(spark, sf_dir) -> list[DataFrame]:
    """Queries and catalog of the title search."""
    split = F.filter(F.split("authors", "; "), lambda x: x != "")
    return [src.load(spark, sf_dir, sql, {"part": "p_partkey"}).withColumn("authors", split) for sql in (src.TITLE_QUERIES, src.TITLE_CATALOG)]


@query("f7_title_search", rules.best_titles(f"SELECT * FROM {_named(src.TITLE_QUERIES)}", f"SELECT * FROM {_named(src.TITLE_CATALOG)}"))
def f7(spark, sf_dir):
    return search.title_search(*title_tables(spark, sf_dir), spelling=True).select("qid", "source", "eid", "title", F.round("score", 6).alias("score"), "confidence")


@query("f7_title_search_in_job", rules.rest_titles(f"SELECT * FROM {_named(src.TITLE_QUERIES)}", f"SELECT * FROM {_named(src.TITLE_CATALOG)}"))
def f7_job(spark, sf_dir):
    """Title search as the jobs run it: by words, and by spelling where words find nothing."""
    return search.title_search(*title_tables(spark, sf_dir)).select("qid", "source", "eid", "title", F.round("score", 6).alias("score"), "confidence")


#: Search hits of three sources and two candidates each, made from orders.
HITS = (
    "SELECT o_orderkey AS doc_id, n AS nth, CASE (o_orderkey + n) % 4 WHEN 0 THEN 'crossref_search' WHEN 1 THEN 'openalex_search' WHEN 2 THEN 'openlibrary_search' ELSE 'semanticscholar_search' END AS source, "
    "concat('T', cast(o_orderkey * 10 + n as varchar(20))) AS title, CASE WHEN (o_orderkey + n) % 5 = 0 THEN 'high' ELSE 'medium' END AS confidence, cast(((o_orderkey * 7 + n * 13) % 100) as double) / 100 AS sanity_score "
    "FROM {orders}, (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) AS k"
)


@query(
    "f8_best_search_match",
    "WITH h AS (SELECT *, sanity_score >= 0.4 AND confidence = 'high' AS strong, sanity_score + CASE WHEN confidence = 'high' THEN 0.05 ELSE 0 END AS total, "
    "CASE source WHEN 'crossref_search' THEN 0 WHEN 'openalex_search' THEN 1 WHEN 'openlibrary_search' THEN 3 ELSE 4 END AS ord, CASE source WHEN 'openlibrary_search' THEN 2 WHEN 'semanticscholar_search' THEN 3 ELSE 1 END AS wave "
    f"FROM {from_(HITS)}), t AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h e WHERE e.doc_id = h.doc_id AND e.source = h.source AND e.nth < h.nth AND e.strong)), "
    "w1 AS (SELECT * FROM t WHERE wave = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, ord, nth) = 1), "
    "w2 AS (SELECT * FROM (SELECT * FROM w1 UNION ALL SELECT * FROM t WHERE wave = 2 AND doc_id NOT IN (SELECT doc_id FROM w1 WHERE strong)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, ord, nth) = 1), "
    "w3 AS (SELECT * FROM (SELECT * FROM w2 UNION ALL SELECT * FROM t WHERE wave = 3 AND doc_id NOT IN (SELECT doc_id FROM w2 WHERE strong)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, ord, nth) = 1) "
    "SELECT doc_id, nth, source, title, round(total, 6) AS total FROM w3",
)
def f8(spark, sf_dir):
    hits = src.load(spark, sf_dir, HITS).withColumns({"sanity_passed": F.col("sanity_score") >= 0.4, "verified": F.lit(True)})
    return search.best_search_match(hits).select("doc_id", "nth", "source", "title", F.round("total", 6).alias("total"))


#: Identifiers of two kinds, one of them not built in, and the catalogs that know them; hits and titles of six search sources.
MORE_POOL = f"SELECT o_orderkey AS doc_id, 'pmid' AS kind, 0 AS pos, cast(o_orderkey as varchar(20)) AS value FROM {{orders}} WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'doi', 0, upper({src.doi('o_orderkey')}) FROM {{orders}} WHERE o_orderkey % 3 = 0"
MORE_CATALOG = f"SELECT *, '' AS pmid FROM ({src.CATALOG}) AS t UNION ALL SELECT 'pubmed_id', concat('Trial ', {src.letters('o_orderkey')}), 'Al Baker', '2001', '', '', '', 'Press', cast(o_orderkey as varchar(20)) FROM {{orders}} WHERE o_orderkey % 5 <> 0"
PUBMED = lookup.IdentifierKind("pmid", "pubmed_id", "pubmed_by_id", "resolved by PubMed id", "pmid")


@query(
    "f5_f6_fourth_kind",
    f"WITH p AS (SELECT * FROM ({src.oracle(MORE_POOL)})), k AS (SELECT * FROM ({src.oracle(MORE_CATALOG)})), h AS (SELECT p.doc_id, p.kind, k.source, k.title, CASE p.kind WHEN 'doi' THEN 'crossref_by_doi' ELSE 'pubmed_by_id' END AS resolver, CASE p.kind WHEN 'doi' THEN 0 ELSE 3 END AS o "
    "FROM p JOIN k ON (p.kind = 'doi' AND k.source = 'crossref_doi' AND k.doi = lower(p.value)) OR (p.kind = 'pmid' AND k.source = 'pubmed_id' AND k.pmid = p.value)) "
    "SELECT doc_id, kind, source, resolver, title, CASE kind WHEN 'doi' THEN 'resolved by DOI via Crossref' ELSE 'resolved by PubMed id' END AS note FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) = 1",
)
def f5_more(spark, sf_dir):
    kinds = (*lookup.KINDS, PUBMED)
    entries = src.load(spark, sf_dir, MORE_CATALOG).withColumn("authors", F.split("authors", "; "))
    hits = lookup.lookup_identifiers(src.load(spark, sf_dir, MORE_POOL), entries, kinds).filter("matched")
    judged = hits.withColumns({"sanity_score": F.lit(1.0), "sanity_passed": F.lit(True)})
    return lookup.best_identifier_match(judged, kinds).select("doc_id", "kind", "source", "resolver", "title", "note")


MORE_SOURCES = (search.SOURCES[0], search.CatalogSource("zbmath_search", 1, 0.95), *search.SOURCES[1:])
_MORE_TITLES = src.TITLE_CATALOG.replace("CASE p_partkey % 5 WHEN 0", "CASE p_partkey % 6 WHEN 5 THEN 'zbmath_search' WHEN 0")


@query("f7_sixth_source", rules.best_titles(f"SELECT * FROM {_named(src.TITLE_QUERIES)}", f"SELECT * FROM {_named(_MORE_TITLES)}", rules._THRESHOLD.replace(" END", " WHEN 'zbmath_search' THEN 0.95 END")))
def f7_more(spark, sf_dir):
    split = F.filter(F.split("authors", "; "), lambda x: x != "")
    q, k = (src.load(spark, sf_dir, sql, {"part": "p_partkey"}).withColumn("authors", split) for sql in (src.TITLE_QUERIES, _MORE_TITLES))
    found = search.title_search(q, k, spelling=True, sources=search.source_table(spark, MORE_SOURCES))
    return found.select("qid", "source", "eid", "title", F.round("score", 6).alias("score"), "confidence")


_MORE_HITS = HITS.replace("CASE (o_orderkey + n) % 4 WHEN 0", "CASE (o_orderkey + n) % 5 WHEN 4 THEN 'zbmath_search' WHEN 0")


@query("f8_sixth_source", ORACLES["f8_best_search_match"].replace(from_(HITS), from_(_MORE_HITS)).replace("WHEN 'openalex_search' THEN 1 WHEN", "WHEN 'zbmath_search' THEN 0.5 WHEN 'openalex_search' THEN 1 WHEN"))
def f8_more(spark, sf_dir):
    hits = src.load(spark, sf_dir, _MORE_HITS).withColumns({"sanity_passed": F.col("sanity_score") >= 0.4, "verified": F.lit(True)})
    best = search.best_search_match(hits, search.source_table(spark, MORE_SOURCES))
    return best.select("doc_id", "nth", "source", "title", F.round("total", 6).alias("total"))


_CQ = f"SELECT *, {d.split_names('authors')} AS names FROM {from_(src.CANDIDATES)}"
_NT = f"len({d.words(d.title('title'))})"
_BEST_CAND = f"SELECT * FROM (SELECT *, {rules.QUALITY} AS quality FROM ({_CQ})) WHERE {rules.USEFUL} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {rules.RANK}) = 1"


@query("g3_candidate_quality", f"SELECT doc_id, pos, round({rules.QUALITY}, 6) AS quality FROM ({_CQ})")
def g3(spark, sf_dir):
    return cands.with_title_flags(candidates(spark, sf_dir)).select("doc_id", "pos", F.round(cands.candidate_quality(), 6).alias("quality"))


@query("g4_best_candidate", f"SELECT doc_id, title, source, round(quality, 6) AS quality FROM ({_BEST_CAND})")
def g4(spark, sf_dir):
    return cands.best_candidate(candidates(spark, sf_dir)).select("doc_id", "title", "source", F.round("quality", 6).alias("quality"))


@query("g5_synthesize", rules.based(f"SELECT * FROM ({rules.synthesized()})"))
def g5(spark, sf_dir):
    return cands.synthesize(cands.prepared(candidates(spark, sf_dir))).withColumn("authors", F.array_join("authors", "; ")).drop("notes")


@query(
    "g6_local_fallback",
    f"SELECT o_orderkey AS doc_id, coalesce(b.title, '') AS title, coalesce(b.source, 'none') AS source, CASE WHEN b.source IS NULL OR b.source IN ('filename_title_only', 'text_header') THEN 'low' ELSE 'medium' END AS confidence, "
    f"coalesce({d.joined(d.authors('b.names'))}, '') AS authors FROM orders LEFT JOIN ({_BEST_CAND}) b ON b.doc_id = o_orderkey",
)
def g6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    return cands.local_fallback(docs, candidates(spark, sf_dir)).select("doc_id", "title", "source", "confidence", F.array_join("authors", "; ").alias("authors"))


@query(
    "g7_dedupe_candidates",
    f"SELECT doc_id, pos, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, title, authors, year, doi, isbn, arxiv ORDER BY pos) AS n FROM {from_(src.CANDIDATES)}) WHERE pos < 3 OR n = 1",
)
def g7(spark, sf_dir):
    return cands.dedupe_candidates(candidates(spark, sf_dir).withColumn("added", F.col("pos") >= 3)).select("doc_id", "pos", "source")


@query(
    "g8_demote_book_source",
    f"SELECT c.doc_id, c.pos, CASE WHEN source = 'grobid' AND {d.book('path', 'text')} THEN greatest(priority, 30) ELSE priority END AS priority FROM {from_(src.CANDIDATES)} JOIN {MENTION_SQL} m USING (doc_id)".replace("c.doc_id", "doc_id").replace("c.pos", "pos").replace(" AS t JOIN (", " AS t JOIN (").replace(" AS t m USING", " AS m USING"),
)
def g8(spark, sf_dir):
    docs = documents(spark, sf_dir)
    flagged = docs.select("doc_id", quality.is_book(F.col("path"), F.col("text")).alias("is_book"))
    return cands.demote_book_source(candidates(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi"), flagged).select("doc_id", "pos", "priority")


def results(spark, sf_dir) -> DataFrame:
    """Identifier matches as results to decide on; every third failed sanity or came from a search."""
    k = F.col("doc_id")
    # the rules join these with themselves: written once, not resolved again for each side
    r = stash(jobs.identifier_resolution(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir)), "results")
    searched = (k % 3) == 0
    return r.withColumns(
        {
            "source": F.when(searched, "crossref_search").otherwise(F.col("source")), "sanity_passed": F.col("sanity_passed") & ~searched, "needs_ocr": (k % 5) == 0, "auto_safe": F.lit(False),
            "notes": F.expr("cast(array() as array<string>)"),
        }
    )


def _flat(df: DataFrame) -> DataFrame:
    lists = [c for c, t in df.dtypes if t == "array<string>"]
    return df.withColumns({c: F.array_join(c, " | ") for c in lists})


@query("h1_soft_auto", rules.based(f"SELECT * FROM ({rules.soft_auto()})"))
def h1(spark, sf_dir):
    return _flat(decide.soft_auto(results(spark, sf_dir), candidates(spark, sf_dir)).select("doc_id", "soft_auto", "soft_auto_reasons"))


@query("h2_h3_h4_corroboration", rules.based(f"SELECT * FROM ({rules.corroboration()})"))
def h2(spark, sf_dir):
    return decide.corroboration_decision(results(spark, sf_dir), candidates(spark, sf_dir)).withColumn("strict_similarity", F.round("strict_similarity", 6))


@query("h5_rescue_match", rules.based(f"SELECT doc_id, sanity_passed, sanity_score, array_to_string(notes, ' | ') AS notes FROM ({rules.rescue()})"))
def h5(spark, sf_dir):
    return _flat(decide.rescue_match(results(spark, sf_dir), candidates(spark, sf_dir)).select("doc_id", "sanity_passed", "sanity_score", "notes"))


@query("h6_downgrade_failed", rules.based(f"SELECT doc_id, confidence, verified, sanity_passed, array_to_string(notes, ' | ') AS notes FROM ({rules.downgraded('(SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN chr(108) || chr(111) || chr(119) ELSE confidence END AS confidence, [source] AS notes) FROM r)')})"))
def h6(spark, sf_dir):
    r = results(spark, sf_dir).withColumns({"confidence": F.when(F.col("doc_id") % 4 == 0, "low").otherwise(F.col("confidence")), "notes": F.array("source")})
    return _flat(decide.downgrade_failed(r).select("doc_id", "confidence", "verified", "sanity_passed", "notes"))


_UNLIKE = "r2 AS MATERIALIZED (SELECT * REPLACE (sanity_passed AS verified, CASE WHEN doc_id % 2 = 0 THEN 'Quite another work' ELSE title END AS title) FROM r)"


@query(
    "h7_prefer_local",
    rules.based(f", {_UNLIKE}, l AS MATERIALIZED ({rules.fallback('r2')}) SELECT doc_id, title, source, confidence, array_to_string(notes, ' | ') AS notes FROM ({rules.prefer_local('r2', 'l')})"),
)
def h7(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("verified", F.col("sanity_passed")).withColumn("title", F.when(F.col("doc_id") % 2 == 0, "Quite another work").otherwise(F.col("title")))
    fallback = cands.local_fallback(r.select("doc_id"), candidates(spark, sf_dir))
    return _flat(decide.prefer_local(r, fallback).select("doc_id", "title", "source", "confidence", "notes"))


FINAL = ("doc_id", "title", "authors", "year", "doi", "isbn", "arxiv", "publisher", "source", "confidence", "verified", "sanity_passed", "sanity_score", "needs_ocr", "auto_safe", "notes", "soft_auto")


def _finalized(spark, sf_dir, mode: str) -> DataFrame:
    out = jobs.resolve(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir), search_catalog(spark, sf_dir), mode, spelling=False)
    return _flat(out.withColumn("sanity_score", F.round("sanity_score", 3)).select(*FINAL))


@query("h8_finalize_w2", rules.finalized())
def h8(spark, sf_dir):
    return _finalized(spark, sf_dir, "default")


@query("h8_finalize_safe_mode", rules.finalized("safe"))
def h8_safe(spark, sf_dir):
    return _finalized(spark, sf_dir, "safe")


def staged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents and their candidates by stage."""
    docs = with_windows(src.load(spark, sf_dir, src.STAGED_DOCS, {"orders": "o_orderkey"})).withColumn("sanity_text", F.col("text"))
    split = lambda c: F.filter(F.split(c, "; "), lambda x: x != "")
    return docs, src.load(spark, sf_dir, src.STAGED, {"orders": "o_orderkey"}).withColumns({"authors": split("authors"), "notes": split("notes")})


def _phased(spark, sf_dir, mode: str) -> DataFrame:
    out = phases.resolve_staged(*staged(spark, sf_dir), catalogs(spark, sf_dir), search_catalog(spark, sf_dir), mode, spelling=False)
    return _flat(out.withColumn("sanity_score", F.round("sanity_score", 3)).select(*FINAL, "phase"))


@query("h8_h9_phased", rules.phased())
def h8_phased(spark, sf_dir):
    return _phased(spark, sf_dir, "default")


@query("h8_h9_phased_safe_mode", rules.phased("safe"))
def h8_phased_safe(spark, sf_dir):
    return _phased(spark, sf_dir, "safe")


#: A table of an earlier run: every third document was auto-safe, every fifth verified in a table of old shape.
EARLIER = f"SELECT path AS \"File Path\", CASE WHEN doc_id % 3 = 0 THEN 'yes' ELSE 'no' END AS \"Auto Safe\", CASE WHEN doc_id % 5 = 0 THEN 'yes' ELSE 'no' END AS \"Verified\" FROM ({src.MENTIONS}) AS t"


@query("f10_w1_resumed_run", rules.based("SELECT doc_id, title, source, CASE WHEN sanity_passed THEN 'auto' ELSE 'review' END AS route, (SELECT count(*) FROM m WHERE doc_id % 3 = 0) AS done, (SELECT count(*) FROM m WHERE doc_id % 5 = 0) AS legacy FROM best WHERE doc_id % 3 <> 0"))
def f10_resumed(spark, sf_dir):
    earlier, cands, entries = src.load(spark, sf_dir, EARLIER), candidates(spark, sf_dir), catalogs(spark, sf_dir)
    run = lambda docs: jobs.identifier_resolution(docs, cands.join(docs.select("doc_id"), "doc_id", "left_semi"), entries).select("doc_id", "title", "source", "route")
    found, counts = jobs.resume(documents(spark, sf_dir), [earlier, earlier.drop("Auto Safe")], run)
    return found.join(F.broadcast(counts), how="cross")  # one row


_STRONG = (
    f"SELECT doc_id, max(CASE WHEN title <> '' AND {_NT} >= 4 AND NOT {d.series('title')} AND (source IN ({', '.join(map(d.text, decide.SEARCHABLE))}) OR source LIKE 'llm:%') THEN 1 ELSE 0 END) AS strong FROM {from_(src.CANDIDATES)} GROUP BY doc_id"
)


@query(
    "h9_deferred_worklist",
    f"WITH {rules.BASE.strip()} SELECT m.doc_id, NOT coalesce(b.sanity_passed, false) AS deferred, CASE WHEN n > 0 AND b.doc_id IS NOT NULL THEN 'skipped: identifier lookup returned metadata' WHEN NOT {d.unreadable('m.text')} AND coalesce(s.strong, 0) = 1 THEN 'skipped: readable text with strong local candidate' "
    f"WHEN n > 0 THEN 'hard-case: identifiers found but lookup failed' ELSE 'hard-case: no_identifier' END AS trigger FROM ({src.oracle(src.MENTIONS)}) AS m LEFT JOIN ({_BEST}) b USING (doc_id) LEFT JOIN ({_STRONG}) s USING (doc_id) "
    f"LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_C8}) WHERE kind <> 'stable' GROUP BY doc_id) p USING (doc_id)".replace("WHEN n > 0", "WHEN coalesce(n, 0) > 0"),
)
def h9(spark, sf_dir):
    docs, c = documents(spark, sf_dir), candidates(spark, sf_dir)
    # texts are read once: for the pool and for the features, of which the flag is one
    pool, known = stash(identifier_pool(docs, c), "pool"), stash(jobs.features(docs), "features")
    n = pool.filter("kind <> 'stable'").groupBy("doc_id").agg(F.count("*").alias("n_identifiers"))
    flags = known.select("doc_id", F.col("features.unreadable").alias("needs_ocr")).join(n, "doc_id", "left").na.fill(0, ["n_identifiers"])
    return decide.deferred_worklist(flags, c, jobs.best_of_pool(pool, catalogs(spark, sf_dir), known)).select("doc_id", "deferred", "trigger")


@query(
    "h10_image_only_text",
    f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(string_agg(trim(concat(title, ' ', replace(authors, '; ', ' '))), ' ' ORDER BY pos), '') ELSE 'text' END AS sanity_text FROM orders LEFT JOIN (SELECT * FROM {from_(src.CANDIDATES)} WHERE source IN ('grobid', 'llm:m')) c ON c.doc_id = o_orderkey GROUP BY o_orderkey",
)
def h10(spark, sf_dir):
    k = F.col("o_orderkey")
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("doc_id"), F.when(k % 2 == 0, "").otherwise("text").alias("sanity_text"), F.lit(True).alias("needs_ocr"))
    vision = candidates(spark, sf_dir).filter(F.col("source").isin("grobid", "llm:m")).withColumn("source", F.concat(F.lit("vision_llm:"), "source"))
    return cands.image_only_text(docs, vision).select("doc_id", "sanity_text")


@query(
    "h11_merge_missing",
    f"SELECT a.doc_id, coalesce(nullif(a.year, ''), b.year, '') AS year, coalesce(nullif(a.doi, ''), b.doi, '') AS doi, CASE WHEN a.authors <> '' THEN a.authors ELSE coalesce(b.authors, '') END AS authors, concat_ws(' | ', nullif(a.notes, ''), nullif(b.notes, '')) AS notes "
    f"FROM (SELECT * FROM {from_(src.CANDIDATES)} WHERE source = 'filename_title_only') a LEFT JOIN (SELECT * FROM {from_(src.CANDIDATES)} WHERE source = 'grobid') b USING (doc_id)",
)
def h11(spark, sf_dir):
    c = candidates(spark, sf_dir)
    shape = ["doc_id", "title", "authors", "year", "doi", "isbn", "arxiv", "notes"]
    a, b = (c.filter(F.col("source") == s).select(*shape) for s in ("filename_title_only", "grobid"))
    return decide.merge_missing(a, b).select("doc_id", "year", "doi", F.array_join("authors", "; ").alias("authors"), F.array_join("notes", " | ").alias("notes"))


_GUESSES = "[" + ", ".join(f"concat({d.text(p)}, stem)" for p in ids.NUMERIC_STEM_PREFIXES) + "]"


def _listed(kind: str) -> str:
    return f"coalesce((SELECT string_agg(value, '; ' ORDER BY pos) FROM pool p WHERE p.doc_id = g.doc_id AND p.kind = '{kind}'), '')"


@query(
    "a20_debug_columns",
    rules.based(
        f""", w AS (SELECT doc_id, regexp_extract(path, '([^/]*)\\.pdf$', 1) AS stem FROM m), guess AS (SELECT doc_id, {_GUESSES} AS gs FROM w WHERE {d.match('stem', '^[0-9]{7,10}$')}),
    own AS (SELECT doc_id, list(value ORDER BY pos) AS vs FROM pool WHERE kind = 'doi' GROUP BY 1),
    dois AS (SELECT doc_id, list_concat(list_concat(list_filter(coalesce(gs, [])[1:1], lambda x: NOT list_contains(coalesce(vs, []), x)), coalesce(vs, [])), coalesce(gs, [])) AS ds FROM own FULL JOIN guess USING (doc_id)),
    g AS (SELECT doc_id, string_agg(source, ' | ' ORDER BY pos) AS candidate_sources, cast(to_json(list(struct_pack(arxiv := arxiv, authors := names, doi := doi, isbn := isbn, notes := notes, priority := priority, source := source, title := title, year := year) ORDER BY pos)) AS varchar) AS candidates_json,
      arg_min(struct_pack(t := title, a := array_to_string(names, '; '), y := year), pos) FILTER (WHERE source = 'grobid' AND title <> '') AS gb FROM c GROUP BY 1),
    b AS (SELECT doc_id, source FROM (SELECT *, {rules.QUALITY} AS quality FROM c) WHERE {rules.USEFUL} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {rules.RANK}) = 1)
    SELECT doc_id, candidate_sources, candidates_json, coalesce(b.source, '') AS local_best_source, coalesce(gb.t, '') AS grobid_title, coalesce(gb.a, '') AS grobid_authors, coalesce(gb.y, '') AS grobid_year,
      coalesce(array_to_string(list_filter(ds, lambda x, i: list_position(ds, x) = i), '; '), '') AS identifier_dois, {_listed('isbn')} AS identifier_isbns, {_listed('arxiv')} AS identifier_arxivs FROM g LEFT JOIN b USING (doc_id) LEFT JOIN dois USING (doc_id)"""
    ),
)
def a20(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return cands.debug_columns(c, identifier_pool(documents(spark, sf_dir), c))


#: What ends up in the tables of a run, with every confidence, and the least one that is asked for.
_IMPORT = "SELECT doc_id, auto_safe, CASE doc_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'odd' ELSE confidence END AS confidence, doc_id % 7 = 0 AS soft_auto FROM (SELECT doc_id, 'high' AS confidence, sanity_passed AS auto_safe FROM best)"
_RANK = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(
    "d14_importable",
    rules.based(
        " UNION ALL ".join(
            f"SELECT doc_id, '{least}' AS least, (auto_safe OR soft_auto) AND {_RANK} >= {n} AS importable, CASE WHEN NOT auto_safe AND NOT soft_auto THEN 'skipped: not auto-safe; manual review required' WHEN {_RANK} < {n} THEN concat('skipped: confidence ', confidence, ' below threshold {least}') ELSE '' END AS reason FROM ({_IMPORT})"
            for n, least in enumerate(("low", "medium", "high"))
        )
    ),
)
def d14(spark, sf_dir):
    k = F.col("doc_id")
    best = jobs.identifier_resolution(documents(spark, sf_dir), candidates(spark, sf_dir), catalogs(spark, sf_dir))
    r = F.struct("auto_safe", (k % 7 == 0).alias("soft_auto"), F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").when(k % 5 == 2, "odd").otherwise(F.col("confidence")).alias("confidence"))
    said = [quality.is_importable(r, least) for least in ("low", "medium", "high")]
    rows = [F.struct(F.lit(least).alias("least"), s["importable"].alias("importable"), s["reason"].alias("reason")) for least, s in zip(("low", "medium", "high"), said)]
    return best.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")
