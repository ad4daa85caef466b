"""Incremental resolution: new documents are resolved as they arrive and published in the routed tables; done ones are not redone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.lookup import keyed
from citeweave.plans.jobs import identifier_resolution
from citeweave.sources.files import routes
from citeweave.streaming.published import compact, publish

DOCUMENTS = "doc_id bigint, path string, text string, ident_text string"
PUBLISHED = "doc_id bigint, source string, title string, sanity_score double, route string"


def resolved(docs: DataFrame, candidates: DataFrame, catalogs: DataFrame) -> DataFrame:
    """(doc_id, source, title, sanity_score, route): a row for each document and table that it goes to."""
    best = identifier_resolution(docs, candidates, catalogs).select("doc_id", "source", "title", "sanity_score", "auto_safe")
    out = docs.select("doc_id").join(best, "doc_id", "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    safe = F.coalesce("auto_safe", F.lit(False))
    return out.select("doc_id", blank("source"), blank("title"), F.coalesce("sanity_score", F.lit(0.0)).alias("sanity_score"), F.explode(routes(safe, F.lit(False))).alias("route"))


def incremental_resolve(
    stream_docs: DataFrame, candidates: Callable[[DataFrame], DataFrame], catalogs: DataFrame, sink: str, checkpoint: str, done: DataFrame | None = None, compact_every: int = 0
):
    """Start the query: each batch of ``stream_docs`` is resolved and published in ``sink`` (``read_published``, partitioned by route).

    A document that arrives again, in the same batch or a later one, before or after a restart, counts once: the stream keeps the ids that it has
    seen as state, in the checkpoint; which of several texts that arrive under one id in one batch counts is not defined. State has an entry an id and is
    kept on disk by the RocksDB store where the session names it (``spark.sql.streaming.stateStore.providerClass``). ``done`` (doc_id) names documents of an
    earlier run that stay as they are. A batch that runs again takes its own place; readers see it as it was or as it is. Every ``compact_every`` batches the folders
    become one.
    """
    entries = keyed(catalogs)

    def append(batch: DataFrame, number: int) -> None:
        fresh = batch if done is None else batch.join(done.select("doc_id"), "doc_id", "left_anti")
        publish(resolved(fresh, candidates(fresh), entries), sink, number, ["route"])
        if compact_every and number and number % compact_every == 0:
            compact(batch.sparkSession, sink, PUBLISHED, ["route"], keep=1)

    once = stream_docs.dropDuplicates(["doc_id"])
    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
