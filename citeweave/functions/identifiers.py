"""DOI, ISBN, arXiv and stable-id extraction: Column → Column, built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.text import given, sub

# Identifier patterns. What is cheap to test and seldom holds comes first.
DOI = r"(?iU)(?=1)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
ARXIV = r"(?iU)(?<![A-Za-z0-9])(?<!stable/)(?:arXiv\s*:?\s*)?((?:\d{4}\.\d{4,5}|[a-z\-]++(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?)\b"
ISBN = r"(?U)(?=\d)(?<!\d)((?:97[89][\-\s]?)?\d[\d\-\s]{8,20}[\dXx])(?!\d)"
STABLE = r"(?iU)\b(stable/\d+)\b"
DOWNLOAD_PII = r"(?iU)(?:^|[\\/\s])1-s2\.0-(S[\dA-Z]{14,18})(?:-\w+)?(?:\.pdf)?"
DOWNLOAD_NUMERIC_PII = r"(?iU)(?:^|[\\/\s])1-s2\.0-(\d[\dA-X]{15})(?:-\w+)?(?:\.pdf)?"
WRITTEN_PII = r"(?iU)\b(S\d{4}-\d{3}[\dX]\(\d{2}\)\d{5}-\d)\b"
PII_LAYOUTS = (r"^S([0-9]{4})([0-9X]{4})([0-9]{2})([0-9]{5})([0-9])\z", r"^([0-9]{4})([0-9X]{4})([0-9]{2})([0-9]{5})([0-9])\z")
# DOI prefixes that a purely numeric file name may stand for, the likeliest first.
NUMERIC_STEM_PREFIXES = ("10.2307/", "10.1214/aop/", "10.1214/aos/", "10.1214/aoms/", "10.1214/aoap/", "10.1214/ss/", "10.1214/lnms/", "10.1214/")


#: A chunk without these characters has none of the pattern, nor one without a match of the second, where there is one.
GUARDS = {
    DOI: ("10.", ""), ARXIV: ("", r"(?U)[./](?:(?<=\d{4}\.)\d{4}|(?<=/)\d{7})"), STABLE: ("/", "(?i)table/"),
    DOWNLOAD_PII: ("2.0-", ""), DOWNLOAD_NUMERIC_PII: ("2.0-", ""), WRITTEN_PII: (")", r"(?U)\)\d{5}-"),
}


def _all(c: Column, pattern: str) -> Column:
    text = F.coalesce(c, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    if pattern not in GUARDS:
        return found
    held, shape = GUARDS[pattern]
    may = text.contains(held) & text.rlike(shape) if held and shape else text.contains(held) if held else text.rlike(shape)
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def _distinct(lists: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.concat(*lists), lambda x: x != ""))


def validate_isbn(c: Column) -> Column:
    """ISBN-10 or ISBN-13 without separators, upper case; '' unless its check digit holds."""

    def checked(s):
        digit = lambda i: s.substr(i, F.lit(1)).cast("int")
        ten = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + i * digit(i))
        last = F.when(s.endswith("X"), 10).otherwise(s.substr(10, 1).try_cast("int"))
        thirteen = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + digit(i) * F.when(i % 2 == 1, 1).otherwise(3))
        return (
            F.when(s.rlike("^[0-9]{9}[0-9X]\\z"), F.when((ten + 10 * last) % 11 == 0, s).otherwise(""))
            .when(s.rlike("^[0-9]{13}\\z"), F.when(thirteen % 10 == 0, s).otherwise(""))
            .otherwise("")
        )

    return given(sub(F.upper(F.coalesce(c, F.lit(""))), "[^0-9X]"), checked)


def pii_to_doi(c: Column) -> Column:
    pii = F.upper(F.trim(c))
    out = F.when(pii.rlike(r"^S[0-9]{4}-[0-9]{3}[0-9X]\([0-9]{2}\)[0-9]{5}-[0-9]\z"), F.concat(F.lit("10.1016/"), pii))
    for lead, layout in zip(("S", ""), PII_LAYOUTS):
        g = [F.regexp_extract(pii, layout, i) for i in range(1, 6)]
        out = out.when(pii.rlike(layout), F.concat(F.lit(f"10.1016/{lead}"), g[0], F.lit("-"), g[1], F.lit("("), g[2], F.lit(")"), g[3], F.lit("-"), g[4]))
    return out.otherwise("")


def extract_dois(*chunks: Column) -> Column:
    lists = []
    for c in chunks:
        lists.append(F.transform(_all(c, DOI), lambda x: F.rtrim(x, F.lit(").,;:"))))
        lists += [F.transform(_all(c, p), pii_to_doi) for p in (DOWNLOAD_PII, DOWNLOAD_NUMERIC_PII, WRITTEN_PII)]
    return _distinct(lists)


def extract_isbns(*chunks: Column) -> Column:
    return _distinct([F.transform(_all(c, ISBN), validate_isbn) for c in chunks])


def extract_arxivs(*chunks: Column) -> Column:
    return F.filter(_distinct([_all(c, ARXIV) for c in chunks]), lambda x: ~F.lower(x).startswith("stable/"))


def extract_stable_ids(*chunks: Column) -> Column:
    return _distinct([_all(c, STABLE) for c in chunks])


def filename_dois(stem: Column) -> Column:
    guesses = F.array(*(F.concat(F.lit(p), stem) for p in NUMERIC_STEM_PREFIXES))
    return F.when(stem.rlike("^[0-9]{7,10}\\z"), guesses).otherwise(F.array().cast("array<string>"))


def pooled_dois(found: Column, of_candidates: Column, stem: Column) -> Column:
    """The likeliest guess of a numeric file name leads, unless it was found; the other guesses close the pool."""
    guesses = filename_dois(stem)
    pool = F.array_distinct(F.concat(found, F.filter(of_candidates, lambda x: x != "")))
    lead = F.filter(F.slice(guesses, 1, 1), lambda x: ~F.array_contains(pool, x))
    return F.array_distinct(F.concat(lead, pool, guesses))
