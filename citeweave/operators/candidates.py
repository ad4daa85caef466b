"""Candidates per document: quality, best one, synthesis, fallback, identifier pool, debug columns.

Candidates of a document are few; selection is one aggregation by ``doc_id`` with partial sums, never a sort of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeweave.functions.identifiers import extract_arxivs, extract_dois, extract_isbns, extract_stable_ids, pooled_dois
from citeweave.functions.quality import is_garbage_title, is_journal_abbrev, is_suspicious_title
from citeweave.functions.repair import repair_title_ligatures
from citeweave.functions.similarity import normal_similarity
from citeweave.functions.text import basename, clean_author_list, normalize_title, stem, words

FIELDS = ("title", "authors", "year", "doi", "isbn", "arxiv", "source", "priority", "notes")
KEY = ("source", "title", "authors", "year", "doi", "isbn", "arxiv")


def has_identifier(of=F.col) -> Column:
    return (of("doi") != "") | (of("isbn") != "") | (of("arxiv") != "")


def with_title_flags(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``__t``, what rules ask about a title: its words, its normal form, and whether it is garbage or an abbreviation; worked out once a row."""
    if "__t" in candidates.columns:
        return candidates
    title, norm = F.col("title"), normalize_title(F.col("title"))
    return candidates.withColumn("__t", F.struct(F.size(words(norm)).alias("n"), norm.alias("norm"), is_garbage_title(title).alias("garbage"), is_journal_abbrev(title).alias("abbrev")))


def with_synthesis_flags(candidates: DataFrame) -> DataFrame:
    """``with_title_flags`` and ``__odd``, whether a title is suspicious: all that ``synthesize`` asks about titles. It hands them on, so candidates that are combined again and again are asked once."""
    if "__odd" in candidates.columns:
        return candidates
    return with_title_flags(candidates).withColumn("__odd", is_suspicious_title(F.col("title")))


def candidate_quality() -> Column:
    """Of rows ``with_title_flags``."""
    title, source, n = F.col("title"), F.col("source"), F.col("__t.n")
    by_title = F.when(title == "", 0.0).when(F.col("__t.garbage"), -3.0).when(F.col("__t.abbrev"), -2.0).otherwise(F.least(F.lit(4.0), F.greatest(F.lit(1.0), n / 3.0)))
    return (
        by_title
        + F.when(F.size("authors") > 0, F.least(F.lit(2.0), 0.75 + 0.5 * F.size("authors"))).otherwise(0.0)
        + F.when(F.col("year") != "", 0.4).otherwise(0.0)
        + F.when(has_identifier(), 2.5).otherwise(0.0)
        - F.when(source.isin("filename_title_only", "text_header"), 0.8).otherwise(0.0)
        - F.when((source == "pdfinfo") & (title.startswith("PII:") | (title == "")), 1.5).otherwise(0.0)
        - F.when((title != "") & (n <= 2), 0.5).otherwise(0.0)
    )


def is_useful() -> Column:
    return (F.col("title") != "") | (F.size("authors") > 0) | has_identifier()


def _rank(*before: Column) -> Column:
    """Order of choice: quality, priority, title length, position."""
    return F.struct(*before, (-F.col("quality")).alias("q"), F.col("priority"), (-F.length("title")).alias("l"), F.col("pos"))


def _row() -> Column:
    return F.struct(*FIELDS, "quality")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The best useful candidate of each document: (doc_id, fields, quality)."""
    rated = with_title_flags(candidates.filter(is_useful())).withColumn("quality", candidate_quality()).drop("__t")
    return rated.groupBy("doc_id").agg(F.min_by(_row(), _rank()).alias("best")).select("doc_id", "best.*")


def prepared(candidates: DataFrame) -> DataFrame:
    """Titles repaired and authors cleaned, as synthesis leaves all candidates."""
    fixed = candidates.withColumn("title", F.when(F.col("title") != "", repair_title_ligatures(F.col("title"))).otherwise(""))
    return fixed.withColumn("authors", clean_author_list(F.col("authors")))


def _author_quality() -> Column:
    s = F.col("source")
    by_source = (
        F.when(s.startswith("llm:") | s.startswith("vision_llm:"), 4.0)
        .when(s.isin("grobid", "pdfinfo", "pdf_metadata", "xmp"), 3.0)
        .when(s.isin("filename_author_title", "filename_structured", "filename_series"), 2.0)
        .when(s == "text_header", 1.0)
        .otherwise(0.0)
    )
    return by_source + F.least(F.lit(1.0), 0.25 * F.size("authors")) + F.when(F.col("title") != "", 0.5).otherwise(0.0) + F.when(F.col("year") != "", 0.25).otherwise(0.0)


def synthesize(candidates: DataFrame) -> DataFrame:
    """A ``synthesized`` candidate for each document whose parts give more than a title. ``candidates`` is prepared(); flags that it has (``with_synthesis_flags``) are those of the result too."""
    title = F.col("title")
    flags = [c for c in ("__t", "__odd") if "__odd" in candidates.columns]
    good = (title != "") & ~F.col("__t.garbage") & ~F.col("__t.abbrev") & ~F.col("__odd")
    rated = with_synthesis_flags(candidates).withColumns({"quality": candidate_quality(), "good": good, "norm": F.col("__t.norm")})
    rated = rated if flags else rated.drop("__t", "__odd")
    doc = Window.partitionBy("doc_id")
    by_title = F.min_by(F.struct(*FIELDS, "quality", "norm", *flags), F.when(title != "", _rank((~F.col("good")).alias("bad")))).over(doc)
    rated = rated.withColumn("t", by_title).filter(F.col("t").isNotNull())
    likely = (F.col("source") != "synthesized") & ((title == "") | (normal_similarity(F.col("norm"), F.col("t.norm"), 0.7) >= 0.7))
    rated = rated.withColumn("fits", F.when(F.size("authors") > 0, likely))
    # compatible authors by author quality, else the best local candidate's, synthesized ones last
    by_fit = F.when(F.col("fits"), F.struct(F.lit(0).alias("a"), (-_author_quality()).alias("q"), F.col("priority").cast("double").alias("p"), F.lit(0).alias("l"), F.col("pos")))
    by_rest = F.struct(
        F.when(F.col("source") != "synthesized", 1).otherwise(2).alias("a"), (-F.col("quality")).alias("q"), F.col("priority").cast("double").alias("p"), (-F.length("title")).alias("l"), F.col("pos")
    )
    picked = rated.groupBy("doc_id").agg(
        F.first("t").alias("t"),
        F.min_by("authors", F.when(F.size("authors") > 0, F.coalesce(by_fit, by_rest))).alias("a"),
        F.min_by("year", F.when((F.col("year") != "") & is_useful(), _rank())).alias("y"),
        F.min_by(F.struct("doi", "isbn", "arxiv"), F.when(has_identifier(), _rank())).alias("i"),
    )
    out = picked.select(
        "doc_id",
        F.col("t.title").alias("title"),
        F.coalesce("a", "t.authors").alias("authors"),
        F.coalesce("y", "t.year").alias("year"),
        *(F.coalesce(F.nullif(F.col(f"i.{k}"), F.lit("")), F.col(f"t.{k}")).alias(k) for k in ("doi", "isbn", "arxiv")),
        F.lit("synthesized").alias("source"),
        F.least("t.priority", F.lit(22)).alias("priority"),
        F.array(F.lit("combined local title/author/year candidates")).alias("notes"),
        *(F.col(f"t.{c}").alias(c) for c in flags),
    )
    return out.filter((F.size("authors") > 0) | (F.col("year") != "") | has_identifier())


def local_fallback(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate as an unverified result; a document without one has source ``none``."""
    best = best_candidate(candidates)
    odd = (F.col("source") == "pdfinfo") & F.col("title").startswith("PII:")
    weak = F.col("source").isin("filename_title_only", "text_header") | odd
    joined = docs.select("doc_id").join(best, "doc_id", "left")
    none = F.col("source").isNull()
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    notes = F.concat(
        "notes",
        F.when(odd, F.array(F.lit("pdfinfo title looks like a publisher internal ID"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("best local guess; external verification failed")),
    )
    return joined.select(
        "doc_id",
        blank("title"),
        F.when(none, F.array().cast("array<string>")).otherwise(clean_author_list(F.col("authors"))).alias("authors"),
        *map(blank, ("year", "doi", "isbn", "arxiv")),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.when(none | weak, "low").otherwise("medium").alias("confidence"),
        F.lit(False).alias("verified"),
        F.when(none, F.array(F.lit("no metadata extracted"))).otherwise(notes).alias("notes"),
    )


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """Rows with ``added`` set go where an earlier row of the document has the same key; other rows stay."""
    first = F.row_number().over(Window.partitionBy("doc_id", *KEY).orderBy("pos"))
    return candidates.withColumn("nth", first).filter(~F.col("added") | (F.col("nth") == 1)).drop("nth")


def demote_book_source(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """On books (docs.is_book) ``grobid`` candidates rank 30 at best and say so."""
    book = F.coalesce("is_book", F.lit(False)) & (F.col("source") == "grobid")
    joined = candidates.join(docs.select("doc_id", "is_book"), "doc_id", "left")
    note = F.array(F.lit("grobid demoted (is_book)"))
    return joined.withColumns(
        {"priority": F.when(book, F.greatest("priority", F.lit(30))).otherwise(F.col("priority")), "notes": F.when(book, F.concat("notes", note)).otherwise(F.col("notes"))}
    ).drop("is_book")


def text_identifiers(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, stem, d, i, a, s): the stem of the file name, and DOIs, ISBNs, arXiv and stable ids of name and texts; ``carried`` columns stay."""
    # a document of few pages has the same text in both windows; each pattern asks for the chunks anew, so they are made in a step of their own
    more = F.when(F.col("ident_text").eqNullSafe(F.col("text")), "").otherwise(F.col("ident_text"))
    docs = docs.select("doc_id", *carried, "text", more.alias("__more"), basename(F.col("path")).alias("__name"), stem(F.col("path")).alias("stem"))
    chunks = [F.col("__name"), F.col("text"), F.col("__more")]
    return docs.select(
        "doc_id", *carried, "stem", extract_dois(*chunks).alias("d"), extract_isbns(*chunks).alias("i"), extract_arxivs(*chunks).alias("a"), extract_stable_ids(*chunks).alias("s")
    )


def pooled(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, value) of documents whose ``text_identifiers`` were found, with those of their candidates."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "doi", "isbn", "arxiv"))), lambda x: F.struct(x["doi"].alias("doi"), x["isbn"].alias("isbn"), x["arxiv"].alias("arxiv")))
    found = found.join(candidates.filter(has_identifier()).groupBy("doc_id").agg(own.alias("own")), "doc_id", "left")
    of = lambda k: F.coalesce(F.transform("own", lambda x: x[k]), F.array().cast("array<string>"))
    merged = lambda c, k: F.array_distinct(F.concat(c, F.filter(of(k), lambda x: x != "")))
    kinds = found.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit("doi").alias("kind"), pooled_dois(F.col("d"), of("doi"), F.col("stem")).alias("values")),
                F.struct(F.lit("isbn").alias("kind"), merged("i", "isbn").alias("values")),
                F.struct(F.lit("arxiv").alias("kind"), merged("a", "arxiv").alias("values")),
                F.struct(F.lit("stable").alias("kind"), F.col("s").alias("values")),
            )
        ).alias("k"),
    )
    return kinds.select("doc_id", "k.kind", F.posexplode("k.values").alias("pos", "value"))


def identifier_pool(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, kind, pos, value): distinct identifiers of a document in the order in which they count."""
    return pooled(text_identifiers(docs), candidates)


def debug_columns(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Per document: candidate sources, candidates as JSON, best local source, first grobid fields, identifier lists."""
    shape = F.struct(*sorted(("source", "title", "authors", "year", "doi", "isbn", "arxiv", "priority", "notes")))
    listed = F.array_sort(F.collect_list(F.struct("pos", shape.alias("c"))))
    of_grobid = F.min_by(F.struct("title", "authors", "year"), F.when((F.col("source") == "grobid") & (F.col("title") != ""), F.col("pos")))
    rows = with_title_flags(candidates).withColumn("quality", candidate_quality()).groupBy("doc_id").agg(
        listed.alias("all"), of_grobid.alias("g"), F.min_by("source", F.when(is_useful(), _rank())).alias("local_best_source")
    )
    ids = pool.groupBy("doc_id").agg(
        *(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "value")))), lambda x: x["value"]), "; ").alias(f"identifier_{k}s")
            for k in ("doi", "isbn", "arxiv")
        )
    )
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.join(ids, "doc_id", "left").select(
        "doc_id",
        F.array_join(F.transform("all", lambda x: x["c"]["source"]), " | ").alias("candidate_sources"),
        F.to_json(F.transform("all", lambda x: x["c"])).alias("candidates_json"),
        blank(F.col("local_best_source")).alias("local_best_source"),
        blank(F.col("g.title")).alias("grobid_title"),
        blank(F.array_join("g.authors", "; ")).alias("grobid_authors"),
        blank(F.col("g.year")).alias("grobid_year"),
        *(blank(F.col(f"identifier_{k}s")).alias(f"identifier_{k}s") for k in ("doi", "isbn", "arxiv")),
    )


def image_only_text(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """A document without sanity text that needs OCR takes titles and authors of its vision candidates as its text."""
    said = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif(F.array_join("authors", " "), F.lit(""))).alias("t"))))
    seen = candidates.filter(F.col("source").startswith("vision")).groupBy("doc_id").agg(F.array_join(F.filter(F.transform(said, lambda x: x["t"]), lambda t: t != ""), " ").alias("seen"))
    blind = (F.coalesce("sanity_text", F.lit("")) == "") & F.col("needs_ocr")
    joined = docs.join(seen, "doc_id", "left")
    return joined.withColumn("sanity_text", F.when(blind, F.coalesce("seen", F.lit(""))).otherwise(F.col("sanity_text"))).drop("seen")
