"""Text, author, year and path functions: Column → Column, built-ins only. A missing value counts as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
YEAR = r"(?U)\b(1[5-9]\d{2}|20\d{2}|2100)\b"
ROLE = r"(?iU)(?:\s*[\[(]\s*(?:auth\.?|author|authors|ed\.?|eds\.?|editor|editors)\s*[\])]\s*)+\z"
FOOTNOTE_SIGNS = "∗†‡§¶✝✦⋆*"
TRAILING_WORDS = r"(?iU)\b(?:paper|main|supplementary material|supplement|accepted|final draft)\b\z"
CONFERENCE_YEAR = r"(?iU)^(?:nips|neurips|icml|aistats|jmlr|uai|aaai|cvpr|iclr)[-_ ]+\d{4}[-_ ]+"
BOOK_YEAR = r"(?iU)^\d{4}[_ -]+book[_ -]+"
COPY_NUMBER = r"(?U)\s*\((\d+)\)\z"
CLOSED_YEAR = r"(?U)\s*\((\d{4})(?:\s*,[^)]*)?\)?\z"
OPEN_YEAR = r"(?U)^(.*?)(?:\s*[\[(](\d{4})(?:\s*,.*)?)\z"
GLUED_DIGITS = r"(?U)(?<=[a-zA-Z])\d+"
LONE_NUMBERS = r"(?U)\s+\d+(?=\s|\z)"
_KEPT = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Runs of other characters than small letters and digits, but for single blanks, which stay as they are. Classes of listed characters are looked up in a table.
SEPARATORS = rf"[^{_KEPT}](?:(?<! )|[^{_KEPT}])[^{_KEPT}]*+"
ARCHIVES = (r"(?i)anna.?s archive(?:-[0-9]+)?", r"(?i)libgen\.[A-Za-z0-9]+", r"(?U)\b[0-9a-fA-F]{32}\b")
#: A name without a match of this has none of the above.
ARCHIVED = r"(?i)s archive|libgen\.|[0-9a-f]{32}"
#: What ``\\s`` is in Unicode.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CAMEL_GAPS = (r"(?<=[a-z])(?=[A-Z])", r"(?<=[A-Z])(?=[A-Z][a-z])", r"(?U)(?<=[A-Za-z])(?=\d)", r"(?U)(?<=\d)(?=[A-Za-z])")


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def strip(c: Column, chars: str | None = None) -> Column:
    return F.btrim(c, F.lit(chars or BLANKS))


def given(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body names it, inside its own lambdas too."""
    return F.transform(F.array(value), body)[0]


def words(c: Column) -> Column:
    """Runs of non-blanks of a text whose blanks are single; none of ''."""
    return F.array_remove(F.split(c, " "), "")


def clean_text(c: Column) -> Column:
    return F.trim(sub(F.coalesce(c, F.lit("")), r"(?U)[\x00-\x1f\x7f\s]+", " "))


def _plain(c: Column) -> Column:
    """Small letters; blanks and control characters stay, as both callers turn all but letters and digits into blanks."""
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))


def normalize_title(c: Column) -> Column:
    return F.trim(sub(sub(_plain(c), r"(?U)(?=[ev])\b(?:edition|ed\.?|vol\.?|volume)\b", " "), SEPARATORS, " "))


def normalize_for_sanity(c: Column) -> Column:
    return F.trim(sub(_plain(c), SEPARATORS, " "))


def clean_author_name(c: Column) -> Column:
    bare = sub(clean_text(c), r"[Aa]uthor\(s\):")
    return strip(clean_text(sub(bare, ROLE)), " ,;")


def clean_author_list(authors: Column) -> Column:
    return F.filter(F.transform(authors, clean_author_name), lambda a: a != "")


def normalize_author(c: Column) -> Column:
    bare = F.replace(F.lower(clean_author_name(c)), F.lit("author(s):"), F.lit(""))
    return strip(sub(sub(bare, r"[^a-z\s,.-]", " "), r"\s+", " "), " ,.-")


def strip_footnote_markers(c: Column) -> Column:
    bare = F.translate(c, FOOTNOTE_SIGNS, "")
    return strip(sub(sub(bare, GLUED_DIGITS), LONE_NUMBERS, " "))


def split_authors(c: Column) -> Column:
    none = F.array().cast("array<string>")
    cleaned = lambda parts: F.transform(parts, clean_text)

    def swapped(raw):
        pair = lambda i: F.when(i * 2 + 1 < F.size(raw), clean_text(F.concat_ws(" ", F.get(raw, i * 2 + 1), F.get(raw, i * 2)))).otherwise(F.get(raw, i * 2))
        return F.when(F.size(raw) == 0, none).otherwise(clean_author_list(F.transform(F.sequence(F.lit(0), F.floor((F.size(raw) - 1) / 2).cast("int")), pair)))

    def split(text):
        commas = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        return (
            F.when(text == "", none)
            .when(text.contains(";"), clean_author_list(cleaned(F.split(text, ";"))))
            .when(F.lower(text).contains(" and "), clean_author_list(cleaned(F.split(text, r"(?iU)\band\b"))))
            .when(text.contains(" · "), clean_author_list(cleaned(F.split(text, " · "))))
            .when(commas >= 3, given(F.filter(cleaned(F.split(text, ",")), lambda p: p != ""), swapped))
            .when(commas == 0, F.array(text))
            .otherwise(clean_author_list(cleaned(F.split(text, ","))))
        )

    return given(F.replace(sub(clean_text(c), r"[Aa]uthor\(s\):"), F.lit("_"), F.lit(" ")), split)


def first_year(*chunks: Column) -> Column:
    found = [F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")) for c in chunks]
    return F.coalesce(*found, F.lit(""))


def decamelize(c: Column) -> Column:
    for gap in CAMEL_GAPS:
        c = sub(c, gap, " ")
    return c


def clean_filename_text(c: Column) -> Column:
    s = F.replace(decamelize(clean_text(c)), F.lit("_"), F.lit(" "))
    s = sub(sub(s, r"^\[[^\]]{1,200}\]\s*"), r"(?U)\s+", " ")
    hyphens = lambda x: F.length(x) - F.length(F.replace(x, F.lit("-"), F.lit("")))
    s = given(s, lambda x: F.when((hyphens(x) >= 4) & ~x.contains(" "), F.replace(x, F.lit("-"), F.lit(" "))).otherwise(x))
    s = sub(sub(sub(s, TRAILING_WORDS), CONFERENCE_YEAR), BOOK_YEAR)
    s = sub(sub(s, COPY_NUMBER), r"(?U)\s+", " ")
    return clean_text(strip(s, " -_."))


def strip_title_metadata(c: Column) -> Column:
    """struct(title, year): a trailing '(2020, Publisher)' or open '[2020 …' leaves the title."""
    tidy = lambda x: strip(clean_text(x), " -_.,;:")

    def cut(raw, closed):
        return (
            F.when(closed != raw, F.struct(tidy(closed).alias("title"), first_year(raw).alias("year")))
            .when(raw.rlike(OPEN_YEAR), F.struct(tidy(F.regexp_extract(raw, OPEN_YEAR, 1)).alias("title"), F.regexp_extract(raw, OPEN_YEAR, 2).alias("year")))
            .otherwise(F.struct(raw.alias("title"), first_year(raw).alias("year")))
        )

    return given(clean_text(c), lambda raw: given(sub(raw, CLOSED_YEAR), lambda closed: cut(raw, closed)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*+)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"^(.+?)(?:\.[^.]*)?\z", 1)


def path_tags(root: str, path: Column) -> Column:
    """Folder names between ``root`` and the file; numeric folders do not count; ['imported'] if none is left."""
    inside = path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path))
    folders = F.slice(F.split(inside, "/"), 1, F.size(F.split(inside, "/")) - 1)
    kept = F.filter(folders, lambda p: ~p.rlike(r"^[0-9\-.]+\z"))
    tags = F.filter(F.transform(kept, lambda p: clean_text(F.replace(p, F.lit(","), F.lit(" ")))), lambda p: p != "")
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("imported")))


def author_surname(c: Column) -> Column:
    tokens = F.transform(F.split(c, r"(?U)[\s,]+"), lambda t: F.lower(sub(t, "[^a-zA-Z]")))
    return F.coalesce(F.try_element_at(F.filter(tokens, lambda t: F.length(t) >= 3), F.lit(-1)), F.lit(""))


def normalize_filename(name: Column) -> Column:
    base = sub(basename(F.coalesce(name, F.lit(""))), r"(?i)\.pdf\z")

    def bare(name):
        out = name
        for junk in ARCHIVES:
            out = sub(out, junk, " ")
        return F.when(name.rlike(ARCHIVED), out).otherwise(name)

    return F.trim(F.lower(sub(given(base, bare), "[^a-zA-Z0-9]+", " ")))
