"""Identifier resolution: equi-joins of distinct identifiers with catalogs, scoring, and the winner of each document."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.identifiers import validate_isbn
from citeweave.functions.sanity import apply_sanity, sanity_score
from citeweave.operators.reduce import asked_for
from citeweave.storage import stash

@dataclass(frozen=True)
class IdentifierKind:
    """A kind of identifier as data: where its entries come from, in which column they have it, and how values are compared (``lower``, ``isbn`` or as they are)."""

    kind: str
    source: str
    resolver: str
    note: str
    column: str
    fold: str = ""

    def __post_init__(self):
        if not re.search("_(doi|isbn|id)$", self.source):
            raise ValueError(f"the name of an identifier source ends in _doi, _isbn or _id: {self.source!r}")
        if self.fold not in ("", "lower", "isbn"):
            raise ValueError(f"no such fold: {self.fold!r}")


# Each kind's catalog source, resolver and note, in the order in which kinds are tried.
KINDS = (
    IdentifierKind("doi", "crossref_doi", "crossref_by_doi", "resolved by DOI via Crossref", "doi", "lower"),
    IdentifierKind("isbn", "openlibrary_isbn", "openlibrary_by_isbn", "resolved by ISBN via OpenLibrary", "isbn", "isbn"),
    IdentifierKind("arxiv", "arxiv_id", "arxiv_by_id", "resolved by arXiv ID", "arxiv"),
)
ENTRY = ("title", "authors", "year", "doi", "isbn", "arxiv", "publisher")


def kinds_of(table: DataFrame) -> tuple[IdentifierKind, ...]:
    """The kinds that a small table names, (rank, kind, source, resolver, note, column, fold), a row each, in the order of ``rank``."""
    return tuple(IdentifierKind(*r) for r in table.orderBy("rank").select("kind", "source", "resolver", "note", "column", "fold").collect())


def _chosen(kinds: tuple[IdentifierKind, ...], pick) -> Column:
    """``pick`` of the row's kind; null for a kind that isn't there."""
    out = F
    for k in kinds:
        out = out.when(F.col("kind") == k.kind, pick(k))
    return out


def kind_order(kind: Column, kinds: tuple[IdentifierKind, ...] = KINDS) -> Column:
    out = F
    for n, k in enumerate(kinds):
        out = out.when(kind == k.kind, n)
    return out.otherwise(len(kinds))


def key_of(value: Column, kinds: tuple[IdentifierKind, ...] = KINDS) -> Column:
    """What is compared of a row's value: DOIs whatever their case, ISBNs after validation."""
    folds = {"lower": F.lower, "isbn": validate_isbn, "": lambda v: v}
    return _chosen(kinds, lambda k: folds[k.fold](value))


def _by_key(catalogs: DataFrame, kinds: tuple[IdentifierKind, ...]) -> DataFrame:
    """(kind, key, entry, rank): rank puts the entry that wins first, by ``arrival`` where catalogs have it, else by its text."""
    kind, value = F, F
    for k in kinds:
        kind, value = kind.when(F.col("source") == k.source, k.kind), value.when(F.col("source") == k.source, F.col(k.column))
    arrival = F.col("arrival").cast("long") if "arrival" in catalogs.columns else F.lit(0).cast("long")
    entry = F.struct(*ENTRY)
    rows = catalogs.select(kind.alias("kind"), value.alias("value"), entry.alias("entry"), F.struct(arrival.alias("arrival"), F.to_json(entry).alias("text")).alias("rank"))
    rows = rows.select("kind", key_of(F.col("value"), kinds).alias("key"), "entry", "rank")
    return rows.filter(F.col("kind").isNotNull() & (F.col("key") != ""))


def catalog_keys(catalogs: DataFrame, wanted: DataFrame | None = None, kinds: tuple[IdentifierKind, ...] = KINDS) -> DataFrame:
    """(kind, key, entry): a row for each identifier by which an authoritative entry is found; of several the first to arrive, without ``arrival`` the least JSON text.

    With ``wanted`` (kind, key) most entries that nobody asks for stay out of the shuffle.
    """
    rows = _by_key(catalogs, kinds)
    if wanted is not None:
        rows = asked_for(rows, wanted, ["kind", "key"])
    return rows.groupBy("kind", "key").agg(F.min_by("entry", "rank").alias("entry"))


def is_keyed(catalogs: DataFrame) -> bool:
    return {"kind", "key", "entry"} <= set(catalogs.columns)


def keyed(catalogs: DataFrame, wanted: DataFrame | None = None, kinds: tuple[IdentifierKind, ...] = KINDS) -> DataFrame:
    """``catalog_keys`` as a table of its own; one that was made before stays as it is."""
    return catalogs if is_keyed(catalogs) else stash(catalog_keys(catalogs, wanted, kinds), "catalog-keys")


def write_keyed(catalogs: DataFrame, name: str, buckets: int) -> DataFrame:
    """``catalog_keys`` as the table ``name``, bucketed by key: joins read it without an exchange, run after run."""
    catalog_keys(catalogs).write.bucketBy(buckets, "kind", "key").sortBy("kind", "key").saveAsTable(name)
    return catalogs.sparkSession.table(name)


def update_keyed(name: str, catalogs: DataFrame, new_name: str, buckets: int) -> DataFrame:
    """The table ``name`` with the entries of ``catalogs``, which take the place of earlier ones, as the table ``new_name``; only the new entries are shuffled if ``buckets`` is unchanged."""
    old, new = catalogs.sparkSession.table(name), stash(catalog_keys(catalogs), "catalog-keys").withColumnRenamed("entry", "new")
    both = old.join(new.hint("merge"), ["kind", "key"], "full_outer")
    both.select("kind", "key", F.coalesce("new", "entry").alias("entry")).write.bucketBy(buckets, "kind", "key").sortBy("kind", "key").saveAsTable(new_name)
    return catalogs.sparkSession.table(new_name)


def lookup_identifiers(pool: DataFrame, catalogs: DataFrame, kinds: tuple[IdentifierKind, ...] = KINDS) -> DataFrame:
    """``pool`` rows (doc_id, kind, pos, value) with ``matched``, ``source``, ``resolver`` and the entry's fields.

    The pool, whose texts are dear to search, is written once, and so is the part of the catalog that it asks for: both sides of the join are
    plain exchanges, which Spark splits where one identifier is cited very often. A catalog that is ``keyed`` already is taken as it is.
    """
    wanted = pool.filter(F.col("kind").isin([k.kind for k in kinds])).withColumn("key", key_of(F.col("value"), kinds))
    if not is_keyed(catalogs):
        wanted = stash(wanted, "wanted")
        catalogs = keyed(catalogs, wanted, kinds)
    joined = wanted.join(catalogs, ["kind", "key"], "left")
    return joined.select(
        "doc_id", "kind", "pos", "value", F.col("entry").isNotNull().alias("matched"), _chosen(kinds, lambda k: k.resolver).alias("resolver"),
        F.when(F.col("entry").isNotNull(), _chosen(kinds, lambda k: k.source)).otherwise("").alias("source"), *(F.col(f"entry.{c}").alias(c) for c in ENTRY),
    )


def scored_hits(lookups: DataFrame, features: DataFrame) -> DataFrame:
    """Matched lookups with sanity_score and sanity_passed; ``features`` is (doc_id, features), the slim side of documents."""
    hits = lookups.filter("matched").join(features, "doc_id")
    judged = apply_sanity(sanity_score(F.col("title"), F.col("authors"), F.col("source"), F.col("features")))
    return hits.withColumn("judged", judged).select(*lookups.columns, "judged.*")


def best_identifier_match(hits: DataFrame, kinds: tuple[IdentifierKind, ...] = KINDS) -> DataFrame:
    """One hit a document: the first that passes, by kind and pool order, else the highest score, the earliest of ties.

    A kind after a passing hit is never looked at, so the first passing one wins whatever its score.
    """
    order = kind_order(F.col("kind"), kinds)
    rank = F.struct((~F.col("sanity_passed")).alias("failed"), F.when(F.col("sanity_passed"), 0.0).otherwise(-F.col("sanity_score")).alias("s"), order.alias("k"), F.col("pos"))
    fields = [c for c in hits.columns if c != "doc_id"]
    best = hits.groupBy("doc_id").agg(F.min_by(F.struct(*fields), rank).alias("b")).select("doc_id", "b.*")
    return best.withColumn("note", _chosen(kinds, lambda k: k.note)).withColumn("confidence", F.lit("high")).withColumn("verified", F.lit(True))
