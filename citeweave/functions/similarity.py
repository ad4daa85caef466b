"""Title and author similarity, match score and confidence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.functions.text import given, normalize_author, normalize_title, words

HIGH, MEDIUM, BOOK = 0.97, 0.90, 0.92


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching blocks over both lengths; null for a null. The order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct words of two normalised titles."""
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def may_reach(x: Column, y: Column, least: float) -> Column:
    """Whether the sequence ratio of two texts can be ``least`` or more, by built-ins alone.

    It leaves (1 - ratio)(a + b) characters unmatched, never fewer than the difference of lengths or the edit distance.
    """
    la, lb = F.length(x), F.length(y)
    most = F.floor((1 - least) * (la + lb) + 1e-9).cast("int")
    # beyond the limit the distance is -1, and it stops there
    return (2.0 * F.least(la, lb) >= least * (la + lb)) & (F.call_function("levenshtein", x, y, most) >= 0)


def normal_similarity(x: Column, y: Column, least: float = 0.0) -> Column:
    """Of two normalised titles: 1 if equal, 0 if one is blank, else the larger of sequence ratio and word Jaccard.

    Pairs whose ratio cannot reach ``least`` skip the helper.
    """
    need = (x != y) & (x != "") & (y != "")
    if least > 0:
        need = need & may_reach(x, y, least)
    ratio = sequence_ratio(F.when(need, x), F.when(need, y))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.greatest(F.coalesce(ratio, F.lit(0.0)), word_jaccard(x, y)))


def title_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    return normal_similarity(normalize_title(a), normalize_title(b), least)


def surnames(authors: Column) -> Column:
    norm = F.filter(F.transform(authors, normalize_author), lambda n: n != "")
    last = lambda n: F.when(n.contains(","), F.trim(F.substring_index(n, ",", 1))).otherwise(F.substring_index(n, " ", -1))
    return F.array_distinct(F.filter(F.transform(norm, last), lambda s: s != ""))


def author_overlap(a: Column, b: Column) -> Column:
    shared = lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))
    return given(F.struct(surnames(a).alias("x"), surnames(b).alias("y")), lambda s: shared(s["x"], s["y"]))


def match_score(similarity: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column) -> Column:
    by_author = F.when((F.size(authors_a) > 0) & (author_overlap(authors_a, authors_b) >= 0.5), 0.05).otherwise(0.0)
    by_year = F.when((year_a != "") & (year_a == year_b), 0.05).otherwise(0.0)
    return similarity + by_author + by_year


def confidence_band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
