"""End-to-end jobs: identifier resolution, title search for the rest, audit of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.sanity import apply_sanity, sanity_score, text_features
from citeweave.operators.candidates import identifier_pool, prepared
from citeweave.operators.compare import legacy_count, previous_rows, resume_split
from citeweave.operators.decide import finalize
from citeweave.operators.lookup import best_identifier_match, lookup_identifiers, scored_hits
from citeweave.operators.search import best_search_match, search_queries, title_search
from citeweave.sources.files import routes
from citeweave.storage import stash


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features): all that scoring needs of a document; the text stays behind."""
    return docs.select("doc_id", text_features(F.col("text"), F.col("path")).alias("features"))


def identifier_resolution(docs: DataFrame, candidates: DataFrame, catalogs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """W1: the best identifier match of each document that has one, with its route. ``known``: the documents' ``features``, where they were made before.

    Two shuffles carry data: identifiers to the catalogs, hits back to the slim document side.
    """
    return best_of_pool(identifier_pool(docs, candidates), catalogs, features(docs) if known is None else known)


def best_of_pool(pool: DataFrame, catalogs: DataFrame, known: DataFrame) -> DataFrame:
    """``identifier_resolution`` of documents whose ``identifier_pool`` and ``features`` are there."""
    best = best_identifier_match(scored_hits(lookup_identifiers(pool, catalogs), known))
    safe = F.col("sanity_passed") & F.col("verified") & (F.col("confidence") == "high")
    return best.withColumn("auto_safe", safe).withColumn("route", F.array_join(routes(safe, F.lit(False)), ","))


def search_hits(features: DataFrame, candidates: DataFrame, catalog: DataFrame, **searching) -> DataFrame:
    """Title-search matches of documents, whose ``features`` are (doc_id, features), with sanity_score and sanity_passed. ``searching`` goes to ``title_search``."""
    queries = search_queries(candidates).withColumn("qid", F.xxhash64("doc_id", "nth"))
    hits = title_search(queries, catalog, **searching).join(features, "doc_id")
    judged = apply_sanity(sanity_score(F.col("title"), F.col("authors"), F.col("source"), F.col("features")))
    return hits.withColumn("judged", judged).select(*[c for c in hits.columns if c != "features"], "judged.*")


def resolve(docs: DataFrame, candidates: DataFrame, catalogs: DataFrame, search_catalog: DataFrame, mode: str = "default", **searching) -> DataFrame:
    """W2: identifiers first, title search for what they leave, decision rules, fallback: one result a document. ``searching`` goes to ``title_search``: ``spelling=True`` is the exact way."""
    # several passes look at each of these: written once, read by all
    ready = stash(prepared(candidates), "candidates")
    slim = stash(features(docs), "features")
    ident = stash(identifier_resolution(docs, ready, catalogs, slim), "identified")
    rest = slim.join(ident.filter("auto_safe").select("doc_id"), "doc_id", "left_anti")
    left = ready.join(rest.select("doc_id"), "doc_id", "left_semi")
    found = stash(best_search_match(search_hits(rest, left, search_catalog, **searching)), "searched")
    docs_flag = stash(slim.select("doc_id", F.col("features.unreadable").alias("needs_ocr")), "flags")
    return finalize(docs_flag, ready, ident, found, mode)


def resume(docs: DataFrame, previous: list[DataFrame], run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Go on from the result tables of earlier runs: ``run`` sees the documents (doc_id, path, ...) that no earlier table has as auto-safe.

    Back come its results, and one row (done, legacy): how many documents were done, and how many verified rows of old tables, without an Auto Safe column, were not taken over.
    """
    earlier = previous_rows(previous)
    split = stash(resume_split(docs.select("doc_id", "path"), earlier), "resumed")
    left = docs.join(split.filter("NOT done").select("doc_id"), "doc_id", "left_semi")
    counts = split.agg(F.count_if("done").alias("done")).join(legacy_count(earlier), how="cross")  # a row each
    return run(left), counts
