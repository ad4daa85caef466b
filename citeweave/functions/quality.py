"""Title, author, line and text predicates: Column → boolean Column, built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions.text import YEAR, given, normalize_title, strip, words

# Word lists and patterns that decide results.
GENERIC_TITLES = (
    "thesis dissertation paper notes chapter chapters lecture lectures slides document main draft introduction appendix preface summary abstract "
    "report manuscript preprint article book review homework exercises problems solutions exam quiz assignment handout handouts tutorial worksheet "
    "a b c d e ass pdf"
).split()
GENERIC_IDENTIFIER_TITLES = [*GENERIC_TITLES, "lecture notes", "course notes", "book review", "review article", "research paper", "term paper", "working paper"]
BLURBS = (
    "the book shows", "the area of", "this electronic", "this paper", "we empirically", "in this paper", "we prove", "we study", "we consider",
    "we present", "we introduce", "we propose", "we show", "we develop",
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SOFTWARE_WORDS = ("print job", "acdsee", "created by", "untitled", "microsoft word", "latex with hyperref", "powerpoint", "libreoffice")
SOFTWARE_FILE = r"(?iU)\.(?:tmp|pdf|tex|dvi|docx?|indd|qxd|fm|qxp)\b"
ISO_SPEC = r"(?iU)^ISO\s*\d{4,}"
SERIES = (
    r"lecture notes in|springer series in|springer monographs in|springer tracts in|studies in logic and the foundations|"
    r"progress in (?:nonlinear|mathematics|theoretical|probability)|modeling and simulation in (?:science|engineering)|wiley classics library|"
    r"graduate texts in (?:mathematics|physics|statistics)|universitext|subseries of lecture notes|applied mathematical sciences|"
    r"grundlehren der mathematischen|ergebnisse der mathematik|north.?holland mathematical library|cambridge studies in advanced mathematics|"
    r"london mathematical society|oxford lecture series|de gruyter studies|texts in applied mathematics|pure and applied mathematics"
)
JOURNALS = (
    "journal of|journal: of|annals of|annals: of|bulletin of|bulletin: of|transactions on|transactions: on|proceedings of|proceedings: of|"
    "conference on|workshop on|reliability engineering|structural safety|illinois journal|electronic journal|statistical science|machine learning,|"
    "advances in|international journal"
)
AFFILIATIONS = (
    "university|université|universidad|universität|universitat|cnrs|inria|institute|institut|department|département|departamento|faculty|faculté|"
    "school of|college of|centre for|center for|laboratory|laboratoire|laboratorio"
)
SENTENCES = (
    r"the area of|the book|this paper|this book|this chapter|this electronic|this article|this volume|in this paper|in this book|in this chapter|"
    r"we study|we prove|we consider|we present|we introduce|we propose|we show|we develop|we empirically|we examine|abstract |abstract\.|"
    r"introduction |introduction\.|keywords"
)
NOISE = (
    r"downloaded from|generated on|jstor|terms and conditions|https?://|doi[:\s]|author\(s\):|title[:\s]|source[:\s]|\d+\z|"
    r"journal of machine learning research\b|neural information processing|advances in neural|published as a conference paper\b|"
    r"(?:submitted|revised|accepted|published)\s+\d+/\d+|under review\b|(?:c|©)\s*\d{4}\s+(?:kluwer|springer|elsevier|wiley|ieee)|copyright\s+\d{4}\b|"
    r"(?:vol(?:ume)?\.?\s+\d+|no\.?\s+\d+).+\d{4}|the annals of (?:statistics|probability|mathematics)\b|(?:illinois|annals|bulletin|proceedings)\s+journal\b|"
    r"institute of mathematical statistics\b"
)
NOT_AUTHORS = r"and\b|of\b|in\b|by\b|with\b|for\b|the\b|a\b|an\b|advisors?\b|editors?\b|series\b|subseries\b|volume\b|vol\b"
FUNCTION_WORDS = (
    "the and of to in a is that for on with as by this be are or from an at it which we not have has was were can will if then also these such our "
    "all any one two more let proof theorem lemma corollary proposition definition example remark where thus hence therefore exists set function space"
).split()
BOOK_NAMES = (
    "springer", "cambridge", "oxford", "elsevier", "wiley", "crc press", "world scientific", "north-holland", "north holland", "academic press",
    "mcgraw", "prentice hall", "chapman", "princeton", "cup", "oup", "birkh", "de gruyter", "marcel dekker", "van nostrand", "libgen", "anna",
)


# Shapes of titles that are none, of journal headers and of abbreviations.
TITLE_SHAPES = (
    r"(?:[A-Z]\.?\s+){1,3}[A-Z][a-z]+\z",
    r"[A-Z]{2,20}\z",
    r"(?U:\d{4},?\s*(?:Vol|No|pp))",
    r"(?U:[A-Z][a-z]+ [A-Z][a-z]+,\s*\d+,\s*\d+)",
    rf"(?iU:(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\z",
)
VOLUME_HEADER = r"(?U)^[A-Z][A-Za-z\s]{2,40}\s+\d{1,3}\s+\(\d{4}\)"
DVI_FILE = r"(?i)^[a-z0-9_.-]+\.dvi\z"
ABBREV_YEAR = r"(?U)^[A-Za-z\s.]{1,30}\s*[-–—]\s*\d{4}\z"
ABBREV_CAPITALS = r"^[A-Z]{2,8}\z"
ABBREV_JOURNAL = r"^J\s+[A-Z][a-z]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_software_title(c: Column) -> Column:
    t = _text(c)
    return (t == "") | t.rlike(r"(?iU)^(?:/|https?://|\w+://)") | t.rlike(SOFTWARE_FILE) | t.rlike(ISO_SPEC) | F.lower(t).rlike(f"(?=[paculm])(?:{'|'.join(SOFTWARE_WORDS)})")


def is_software_author(c: Column) -> Column:
    t = strip(_text(c))
    return (t == "") | t.rlike(r"^[a-z]{3,20}\z") | t.rlike(ISO_SPEC) | t.rlike(SOFTWARE_FILE)


def is_series_banner(c: Column) -> Column:
    return strip(_text(c)).rlike(rf"(?iU)^(?:{SERIES})\b")


def is_journal_header(c: Column) -> Column:
    t = strip(_text(c))
    opening = F.lower(t).rlike(f"^(?:{JOURNALS})") & (t.rlike(YEAR) | (F.size(F.split(t, r"(?U)\s+")) <= 5))
    return (t != "") & (opening | t.rlike(VOLUME_HEADER) | t.rlike(DVI_FILE))


def is_journal_abbrev(c: Column) -> Column:
    t = strip(_text(c))
    return t.rlike(ABBREV_YEAR) | t.rlike(ABBREV_CAPITALS) | (t.rlike(ABBREV_JOURNAL) & (F.length(t) < 40))


def is_garbage_title(c: Column) -> Column:
    t = strip(_text(c))
    few = ~t.rlike(r"\p{L}\P{L}*\p{L}\P{L}*\p{L}")
    ascii_share = F.length(F.regexp_replace(t, r"[^\x20-\x7e]", "")) < F.length(t) * 0.5
    shapes = f"^(?:{'|'.join(TITLE_SHAPES)})"
    return (t == "") | few | t.rlike(shapes) | F.lower(t).rlike("^(?:" + "|".join(BLURBS) + ")") | ascii_share | is_journal_header(t) | is_software_title(t)


def is_suspicious_title(c: Column) -> Column:
    t = strip(_text(c))
    low = F.lower(t)
    return (t != "") & (
        (F.length(t) > 180)
        | t.rlike("@|https?://")
        | t.rlike(r"(?U)(?=S)\bSPIN\s+(?:\d|Springer)")
        | low.contains("internal project num")
        | low.rlike(f"(?=[ucidfsl])(?:{AFFILIATIONS})")
        | low.rlike(f"^(?:{SENTENCES})")
        | t.rlike(r"(?U)(?=\d)\b\d{4,5},\s*[A-Z][a-zéöäü]+,\s*[A-Z][a-zA-Z]+")
    )


def is_noise_line(c: Column) -> Column:
    return _text(c).rlike(rf"(?iU)^(?:{NOISE})")


def is_unreadable_text(c: Column) -> Column:
    """Fewer than 200 characters, or among the first 3,000 fewer than 30 words or under 4 % function words.

    Function words between single blanks mostly settle that a text is readable, however many words it may have: no more than one for two characters.
    """
    t = _text(c)
    known = lambda w: F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS)))

    def unreadable(head):
        readable = given(known(F.split(head, " ")), lambda k: (k >= 30) & (k >= 0.02 * (F.length(head) + 2)))
        tokens = F.regexp_extract_all(head, F.lit(r"(?U)(?=[a-z])\b([a-z]+)\b"), F.lit(1))
        return ~readable & given(tokens, lambda w: (F.size(w) < 30) | (known(w) / F.greatest(F.size(w), F.lit(1)) < 0.04))

    return (F.length(strip(t)) < 200) | given(F.lower(t.substr(1, 3000)), unreadable)


def is_book(filename: Column, text: Column) -> Column:
    t = _text(text)
    head = F.lower(t.substr(1, 20000))
    isbn = t.substr(1, 10000).rlike(r"(?iU)(?=i)\bisbn\b[-\s]?1?[03]?[:\s]*\d")
    doi = t.substr(1, 3000).rlike("10\\.[0-9]{4,9}/")
    named = F.lower(_text(filename)).rlike("|".join(BOOK_NAMES))
    return named | head.contains("cataloging-in-publication") | head.contains("library of congress") | (isbn & ~doi)


def is_too_generic(title: Column, authors: Column, year: Column) -> Column:
    w = words(normalize_title(title))
    one = (F.size(w) == 1) & (F.get(w, F.lit(0)).isin(GENERIC_TITLES) | (F.length(F.get(w, F.lit(0))) <= 3))
    two = (F.size(w) == 2) & F.forall(w, lambda x: x.isin(GENERIC_TITLES))
    known = (F.size(authors) > 0) & (_text(year) != "")
    return (F.size(w) == 0) | ((one | two) & ~known)


def is_searchable(title: Column, authors: Column, year: Column) -> Column:
    return (_text(title) != "") & ~is_too_generic(title, authors, year) & ~is_garbage_title(title) & ~is_journal_header(title) & ~is_journal_abbrev(title)


def is_distinctive_title(c: Column) -> Column:
    norm = normalize_title(c)
    short = (F.length(norm) < 8) & (F.size(words(norm)) < 2)
    return (norm != "") & ~norm.isin(GENERIC_IDENTIFIER_TITLES) & ~short & ~is_garbage_title(c) & ~is_journal_abbrev(c)


def looks_like_authors(c: Column) -> Column:
    t = strip(_text(c))
    capitals = (F.size(F.split(t, r"(?U)\s+")) >= 3) & ~t.rlike(r"[\p{L}&&[^\p{Lu}]]") & ~t.contains(",")
    return (t != "") & ~t.endswith(":") & ~t.rlike(rf"(?iU)^(?:{NOT_AUTHORS})") & ~capitals & ~is_series_banner(t)


def is_importable(result: Column, minimum: str = "medium") -> Column:
    """struct(importable, reason) of a result struct with auto_safe, soft_auto and confidence."""
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    routed = result["auto_safe"] | result["soft_auto"]
    enough = rank(result["confidence"]) >= rank(F.lit(minimum))
    low = F.concat(F.lit("skipped: confidence "), result["confidence"], F.lit(f" below threshold {minimum}"))
    reason = F.when(~routed, "skipped: not auto-safe; manual review required").when(~enough, low).otherwise("")
    return F.struct((routed & enough).alias("importable"), reason.alias("reason"))


