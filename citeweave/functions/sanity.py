"""How well a match fits the document's own text and file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.quality import is_unreadable_text
from citeweave.functions.text import author_surname, given, normalize_filename, normalize_for_sanity, strip, words

LEAST = 0.4
# Sources by kind, and title words that prove nothing.
IDENTIFIER_SOURCES = ("crossref_doi", "openlibrary_isbn", "arxiv_id")
SEARCH_SOURCES = ("crossref_search", "openalex_search", "semanticscholar_search", "openlibrary_search", "google_books_search")
STOP_WORDS = (
    "a an the of in on and or for to with by at is are as from this that these those its their our new second third fourth fifth edition volume vol "
    "part chapter section ed"
).split()


def text_features(text: Column, filename: Column) -> Column:
    """The slim part of a document that scoring needs: compute once, then leave the text behind."""
    t = F.coalesce(text, F.lit(""))
    norm = normalize_for_sanity(t.substr(1, 8000))
    return F.struct(
        (F.length(strip(t)) < 100).alias("short"),
        is_unreadable_text(t).alias("unreadable"),
        norm.alias("norm"),
        words(normalize_filename(filename)).alias("name_words"),
    )


def is_search_source(source: Column) -> Column:
    """Sources of title search, the built-in ones and a caller's: their names end so."""
    return source.isin(*SEARCH_SOURCES) | source.endswith("_search")


def is_identifier_source(source: Column) -> Column:
    """Sources of identifier look-ups, the built-in ones and a caller's."""
    return source.isin(*IDENTIFIER_SOURCES) | source.rlike("_(doi|isbn|id)$")


def sanity_score(title: Column, authors: Column, source: Column, features: Column) -> Column:
    names = F.filter(F.transform(authors, author_surname), lambda s: s != "")
    search, ident = is_search_source(source), is_identifier_source(source)
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    def share(kept, known):
        return F.size(F.filter(kept, known)) / F.greatest(F.size(kept), F.lit(1))

    def scored(x):
        named = lambda w: F.array_contains(features["name_words"], w)
        in_text = lambda w: x["text"].contains(padded(w))
        in_name = F.exists(x["names"], named)
        title_match = (
            F.when(x["title"] == "", 0.0)
            .when(in_text(x["title"]), 1.0)
            .when(F.size(x["three"]) == 0, 0.3)
            .otherwise(share(x["three"], in_text))
        )
        author_match = F.when(in_name | F.exists(x["names"], in_text), 1.0).otherwise(0.0)
        name_hit = (F.size(x["four"]) > 0) & (F.size(features["name_words"]) > 0) & (share(x["four"], named) >= 0.4)
        blind = F.when(ident, 0.6).when(search & in_name, 0.6)
        return (
            F.when(features["short"], blind.otherwise(0.0))
            .when(features["unreadable"], blind.when(search & name_hit, 0.5).otherwise(0.0))
            .otherwise(0.6 * title_match + 0.4 * author_match)
        )

    def weighed(x):
        heavy = lambda least: F.filter(words(x), lambda w: (F.length(w) >= least) & ~w.isin(STOP_WORDS))
        known = F.struct(x.alias("title"), heavy(3).alias("three"), heavy(4).alias("four"), names.alias("names"), padded(features["norm"]).alias("text"))
        return given(known, scored)

    return given(normalize_for_sanity(title), weighed)


def apply_sanity(score: Column) -> Column:
    """struct(sanity_score, sanity_passed): rounded first, then compared."""
    return given(F.round(score, 3), lambda r: F.struct(r.alias("sanity_score"), (r >= LEAST).alias("sanity_passed")))
