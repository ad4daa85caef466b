"""The column functions once more as DuckDB SQL text, for the queries' counterparts. Each takes and gives SQL expressions.

Written for DuckDB's RE2 (no look-around) and its list functions, independently of the Spark expressions.
"""

from __future__ import annotations

from citeweave.functions import quality as q
from citeweave.functions import repair
from citeweave.functions import text as tx
from citeweave.functions.sanity import IDENTIFIER_SOURCES, SEARCH_SOURCES, STOP_WORDS
from citeweave.operators import extract

BLANKS = r"\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {text(pattern)}, {text(by)}, 'g')"


def match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {text(pattern)})"


def strip(x: str, chars: str | None = None) -> str:
    return f"trim({x}, {text(chars)})" if chars else sub(x, rf"^[{BLANKS}]+|[{BLANKS}]+$")


def clean(x: str) -> str:
    return f"trim({sub(f'coalesce({x}, chr(0))', f'[{BLANKS}]+', ' ')})"


def plain(x: str) -> str:
    return f"replace(lower({clean(x)}), '&', ' and ')"


def title(x: str) -> str:
    return f"trim({sub(sub(plain(x), r'\b(?:edition|ed\.?|vol\.?|volume)\b', ' '), '[^a-z0-9]+', ' ')})"


def sanity(x: str) -> str:
    return f"trim({sub(plain(x), '[^a-z0-9]+', ' ')})"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def author(x: str) -> str:
    roles = r"(?i)(?:\s*[\[(]\s*(?:auth\.?|author|authors|ed\.?|eds\.?|editor|editors)\s*[\])]\s*)+$"
    return strip(clean(sub(sub(clean(x), r"[Aa]uthor\(s\):"), roles)), " ,;")


def authors(lst_: str) -> str:
    return f"list_filter(list_transform({lst_}, lambda a: {author('a')}), lambda a: a <> '')"


def norm_author(x: str) -> str:
    return strip(sub(sub(f"replace(lower({author(x)}), 'author(s):', '')", r"[^a-z\s,.-]", " "), r"\s+", " "), " ,.-")


def split_names(x: str) -> str:
    """';'-joined text → list of names as they are."""
    return f"list_filter(string_split({x}, '; '), lambda n: n <> '')"


def split_authors(x: str) -> str:
    t = f"replace({sub(clean(x), r'[Aa]uthor\(s\):')}, '_', ' ')"
    each = lambda parts: f"list_transform({parts}, lambda p: {clean('p')})"
    commas = f"(length({t}) - length(replace({t}, ',', '')))"
    raw = f"list_filter({each(f'string_split({t}, chr(44))')}, lambda p: p <> '')"
    swapped = f"list_transform(range(0, (len({raw}) + 1) // 2), lambda i: CASE WHEN 2*i + 1 < len({raw}) THEN {clean(f'concat({raw}[2*i + 2], chr(32), {raw}[2*i + 1])')} ELSE {raw}[2*i + 1] END)"
    return (
        f"CASE WHEN {t} = '' THEN []::varchar[] WHEN contains({t}, ';') THEN {authors(each(f'string_split({t}, chr(59))'))} "
        f"WHEN contains(lower({t}), ' and ') THEN {authors(each(f'''regexp_split_to_array({t}, '(?i)\\band\\b')'''))} "
        f"WHEN contains({t}, ' · ') THEN {authors(each(f'string_split({t}, {text(chr(32) + chr(183) + chr(32))})'))} "
        f"WHEN {commas} >= 3 THEN {authors(swapped)} WHEN {commas} = 0 THEN [{t}] ELSE {authors(each(f'string_split({t}, chr(44))'))} END"
    )


def first_year(x: str) -> str:
    return f"regexp_extract({x}, '\\b(1[5-9]\\d{{2}}|20\\d{{2}}|2100)\\b', 1)"


def surname(x: str) -> str:
    tokens = f"list_transform(regexp_split_to_array({x}, '[{BLANKS},]+'), lambda t: lower({sub('t', '[^a-zA-Z]')}))"
    return f"coalesce(list_filter({tokens}, lambda t: length(t) >= 3)[-1], '')"


def surnames(lst_: str) -> str:
    norm = f"list_filter(list_transform({lst_}, lambda a: {norm_author('a')}), lambda n: n <> '')"
    return f"list_distinct(list_filter(list_transform({norm}, lambda n: CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE split_part(n, ' ', -1) END), lambda s: s <> ''))"


def overlap(a: str, b: str) -> str:
    x, y = surnames(a), surnames(b)
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / least(len({x}), len({y})) END"


def jaccard(a: str, b: str) -> str:
    """Of two normalised titles."""
    x, y = words(a), words(b)
    return f"len(list_intersect({x}, {y})) / greatest(len(list_distinct(list_concat({x}, {y}))), 1)"


def basename(x: str) -> str:
    return f"regexp_extract({x}, '([^/\\\\]*)$', 1)"


def filename(x: str) -> str:
    b = sub(basename(f"coalesce({x}, '')"), r"(?i)\.pdf$")
    for junk in (r"(?i)anna.?s archive(?:-[0-9]+)?", r"(?i)libgen\.[A-Za-z0-9]+", r"(?i)\b[0-9a-f]{32}\b"):
        b = sub(b, junk, " ")
    return f"trim(lower({sub(b, '[^a-zA-Z0-9]+', ' ')}))"


def isbn(x: str) -> str:
    s = f"{sub(f'upper({x})', '[^0-9X]')}"
    digit = lambda i: f"cast(substr({s}, {i}, 1) as int)"
    ten = " + ".join(f"{i} * {digit(i)}" for i in range(1, 10)) + f" + 10 * (CASE WHEN {s} LIKE '%X' THEN 10 ELSE cast(substr({s}, 10, 1) as int) END)"
    thirteen = " + ".join(f"{1 if i % 2 else 3} * {digit(i)}" for i in range(1, 14))
    return f"CASE WHEN {match(s, '^[0-9]{9}[0-9X]$')} THEN CASE WHEN ({ten}) % 11 = 0 THEN {s} ELSE '' END WHEN {match(s, '^[0-9]{13}$')} THEN CASE WHEN ({thirteen}) % 10 = 0 THEN {s} ELSE '' END ELSE '' END"


def found(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {text(pattern)}, 1)"


def dois(x: str) -> str:
    return f"list_transform({found(x, r'(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b')}, lambda d: rtrim(d, ').,;:'))"


def unique(lst_: str) -> str:
    """Distinct non-blank values, sorted."""
    return f"list_sort(list_distinct(list_filter({lst_}, lambda v: v <> '')))"


def joined(lst_: str, sep: str = "; ") -> str:
    return f"array_to_string({lst_}, {text(sep)})"


# predicates


def software_title(x: str) -> str:
    return f"({x} = '' OR {match(x, r'(?i)^(?:/|https?://|\w+://)')} OR {match(x, q.SOFTWARE_FILE.replace('(?iU)', '(?i)'))} OR {match(x, '(?i)^ISO[ ]*[0-9]{4,}')} OR {match(f'lower({x})', '|'.join(q.SOFTWARE_WORDS))})"


def software_author(x: str) -> str:
    t = strip(x)
    return f"({t} = '' OR {match(t, '^[a-z]{3,20}$')} OR {match(t, '(?i)^ISO[ ]*[0-9]{4,}')} OR {match(t, q.SOFTWARE_FILE.replace('(?iU)', '(?i)'))})"


def series(x: str) -> str:
    return match(strip(x), rf"(?i)^(?:{q.SERIES})\b")


def n_words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[{BLANKS}]+'), lambda w: w <> ''))"


def journal_header(x: str) -> str:
    t = strip(x)
    return (
        f"({t} <> '' AND (({match(f'lower({t})', f'^(?:{q.JOURNALS})')} AND ({first_year(t)} <> '' OR {n_words(t)} <= 5)) "
        f"OR {match(t, r'^[A-Z][A-Za-z\s]{2,40}\s+[0-9]{1,3}\s+\([0-9]{4}\)')} OR {match(t, r'(?i)^[a-z0-9_.-]+\.dvi$')}))"
    )


def journal_abbrev(x: str) -> str:
    t = strip(x)
    return f"({match(t, r'^[A-Za-z\s.]{1,30}\s*[-–—]\s*[0-9]{4}$')} OR {match(t, '^[A-Z]{2,8}$')} OR ({match(t, r'^J\s+[A-Z][a-z]')} AND length({t}) < 40))"


def garbage(x: str) -> str:
    t = strip(x)
    shapes = (
        r"^(?:(?:[A-Z]\.?\s+){1,3}[A-Z][a-z]+$|[A-Z]{2,20}$|[0-9]{4},?\s*(?:Vol|No|pp)|[A-Z][a-z]+ [A-Z][a-z]+,\s*[0-9]+,\s*[0-9]+|"
        rf"(?i:(?:{q.MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}})$)"
    )
    return (
        f"({t} = '' OR length({sub(t, r'\P{L}')}) < 3 OR {match(t, shapes)} OR {match(f'lower({t})', '^(?:' + '|'.join(q.BLURBS) + ')')} "
        f"OR length({sub(t, r'[^\x20-\x7e]')}) < length({t}) * 0.5 OR {journal_header(t)} OR {software_title(t)})"
    )


def suspicious(x: str) -> str:
    t = strip(x)
    return (
        f"({t} <> '' AND (length({t}) > 180 OR {match(t, '@|https?://')} OR {match(t, r'\bSPIN\s+(?:\d|Springer)')} OR contains(lower({t}), 'internal project num') "
        f"OR {match(f'lower({t})', q.AFFILIATIONS)} OR {match(f'lower({t})', f'^(?:{q.SENTENCES})')} OR {match(t, r'\b\d{4,5},\s*[A-Z][a-zéöäü]+,\s*[A-Z][a-zA-Z]+')}))"
    )


def noise(x: str) -> str:
    return match(x, "(?i)^(?:" + q.NOISE.replace(r"\z", "$") + ")")


def author_line(x: str) -> str:
    t = strip(x)
    return (
        f"({t} <> '' AND NOT {t} LIKE '%:' AND NOT {match(t, f'(?i)^(?:{q.NOT_AUTHORS})')} "
        f"AND NOT ({n_words(t)} >= 3 AND length({sub(t, r'[^\p{L}]|\p{Lu}')}) = 0 AND NOT contains({t}, ',')) AND NOT {series(t)})"
    )


def too_generic(x: str, n_authors: str, year: str) -> str:
    w = words(title(x))
    generic = lst(q.GENERIC_TITLES)
    return (
        f"(len({w}) = 0 OR (((len({w}) = 1 AND (list_contains({generic}, {w}[1]) OR length({w}[1]) <= 3)) OR (len({w}) = 2 AND list_contains({generic}, {w}[1]) AND list_contains({generic}, {w}[2]))) "
        f"AND NOT ({n_authors} > 0 AND {year} <> '')))"
    )


def searchable(x: str, n_authors: str, year: str) -> str:
    return f"({x} <> '' AND NOT {too_generic(x, n_authors, year)} AND NOT {garbage(x)} AND NOT {journal_header(x)} AND NOT {journal_abbrev(x)})"


def distinctive(x: str) -> str:
    n = title(x)
    return f"({n} <> '' AND NOT list_contains({lst(q.GENERIC_IDENTIFIER_TITLES)}, {n}) AND NOT (length({n}) < 8 AND len({words(n)}) < 2) AND NOT {garbage(x)} AND NOT {journal_abbrev(x)})"


def unreadable(x: str) -> str:
    tokens = f"regexp_extract_all(regexp_replace(lower(substr({x}, 1, 3000)), '[^\\x00-\\x7f]+', '_', 'g'), '\\b([a-z]+)\\b', 1)"
    hits = f"len(list_filter({tokens}, lambda w: list_contains({lst(q.FUNCTION_WORDS)}, w)))"
    return f"(length({strip(x)}) < 200 OR len({tokens}) < 30 OR {hits} / greatest(len({tokens}), 1) < 0.04)"


def book(name: str, x: str) -> str:
    head = f"lower(substr({x}, 1, 20000))"
    return (
        f"({match(f'lower({name})', '|'.join(q.BOOK_NAMES))} OR contains({head}, 'cataloging-in-publication') OR contains({head}, 'library of congress') "
        f"OR ({match(f'substr({x}, 1, 10000)', r'(?i)\bisbn\b[-\s]?1?[03]?[:\s]*\d')} AND NOT {match(f'substr({x}, 1, 3000)', r'10\.[0-9]{4,9}/')}))"
    )


def sanity_score(ttl: str, names: str, source: str, norm: str, name_words: str, short: str, blind: str) -> str:
    """Columns: title, list of authors, source, normalised text, words of the file name, whether text is short, unreadable."""
    tn = sanity(ttl)
    stop = lst(STOP_WORDS)
    heavy = lambda n: f"list_filter({words(tn)}, lambda w: length(w) >= {n} AND NOT list_contains({stop}, w))"
    share = lambda kept, known: f"len(list_filter({kept}, lambda h: list_contains({known}, h))) / greatest(len({kept}), 1)"
    surn = f"list_filter(list_transform({names}, lambda a: {surname('a')}), lambda s: s <> '')"
    in_name = f"len(list_intersect({surn}, {name_words})) > 0"
    ident, search = (f"{source} IN ({', '.join(map(text, s))})" for s in (IDENTIFIER_SOURCES, SEARCH_SOURCES))
    t_match = f"CASE WHEN {tn} = '' THEN 0.0 WHEN contains(concat(' ', {norm}, ' '), concat(' ', {tn}, ' ')) THEN 1.0 WHEN len({heavy(3)}) = 0 THEN 0.3 ELSE {share(heavy(3), words(norm))} END"
    a_match = f"CASE WHEN {in_name} OR len(list_intersect({surn}, {words(norm)})) > 0 THEN 1.0 ELSE 0.0 END"
    early = f"WHEN {ident} THEN 0.6 WHEN {search} AND {in_name} THEN 0.6"
    return (
        f"CASE WHEN {short} THEN CASE {early} ELSE 0.0 END WHEN {blind} THEN CASE {early} WHEN {search} AND len({heavy(4)}) > 0 AND {share(heavy(4), name_words)} >= 0.4 THEN 0.5 ELSE 0.0 END "
        f"ELSE 0.6 * ({t_match}) + 0.4 * ({a_match}) END"
    )


# names of files, split words and header lines


def footnotes(x: str) -> str:
    bare = f"translate({x}, {text(tx.FOOTNOTE_SIGNS)}, '')"
    return strip(sub(sub(bare, "([a-zA-Z])[0-9]+", r"\1"), r"[\s]+[0-9]+(\s|$)", r" \1"))


def decamel(x: str) -> str:
    for pattern in ("([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        x = sub(x, pattern, r"\1 \2")
    return x


def file_title(x: str) -> str:
    s = sub(sub(f"replace({decamel(clean(x))}, '_', ' ')", r"^\[[^\]]{1,200}\]\s*"), rf"[{BLANKS}]+", " ")
    s = f"(CASE WHEN length({s}) - length(replace({s}, '-', '')) >= 4 AND NOT contains({s}, ' ') THEN replace({s}, '-', ' ') ELSE {s} END)"
    s = sub(sub(sub(s, tx.TRAILING_WORDS.replace("(?iU)", "(?i)").replace(r"\z", "$")), tx.CONFERENCE_YEAR.replace("(?iU)", "(?i)")), r"(?i)^[0-9]{4}[_ -]+book[_ -]+")
    return clean(strip(sub(sub(s, r"\s*\([0-9]+\)$"), rf"[{BLANKS}]+", " "), " -_."))


def meta_title(x: str) -> str:
    """The title that a trailing year in brackets leaves."""
    raw, closed = clean(x), sub(clean(x), r"\s*\([0-9]{4}(?:\s*,[^)]*)?\)?$")
    opened = r"^(.*?)(?:\s*[\[(]([0-9]{4})(?:\s*,.*)?)$"
    tidy = lambda y: strip(clean(y), " -_.,;:")
    return f"(CASE WHEN {closed} <> {raw} THEN {tidy(closed)} WHEN {match(raw, opened)} THEN {tidy(f'regexp_extract({raw}, {text(opened)}, 1)')} ELSE {raw} END)"


def meta_year(x: str) -> str:
    raw, closed = clean(x), sub(clean(x), r"\s*\([0-9]{4}(?:\s*,[^)]*)?\)?$")
    opened = r"^(.*?)(?:\s*[\[(]([0-9]{4})(?:\s*,.*)?)$"
    return f"(CASE WHEN {closed} <> {raw} THEN {first_year(raw)} WHEN {match(raw, opened)} THEN regexp_extract({raw}, {text(opened)}, 2) ELSE {first_year(raw)} END)"


def filename_candidates(rows: str) -> str:
    """Candidates of file names without folders and endings: ``rows`` is a query of (doc_id, stem)."""
    hex32, archive, series, pair = r"(?i)^[0-9a-f]{32}$", r"(?i)^Anna'?s Archive(?:-[0-9]+)?$", r"^\(([^)]{1,160})\)\s*(.+?)\s+-\s+(.+?)\s*\(([0-9]{4})(?:\s*,[^)]*)?\)?$", r"^(.*?)\s+-\s+(.+)$"
    raw = sub(sub(sub(clean("stem"), r"(?i)\s+-\s+libgen\.[A-Za-z0-9]+$"), r"(?i)\s+-\s+Anna.?s Archive(?:-[0-9]+)?$"), r"(\([0-9]{4}\))-[0-9]+$", r"\1")
    part = lambda pattern, n: f"regexp_extract(raw, {text(pattern)}, {n})"
    names = lambda x: split_authors(f"replace({x}, '_', '; ')")
    either = lambda a, b: f"coalesce(nullif({a}, ''), {b}, '')"
    leading = sub(clean(part(pair, 1)), r"^[\[(].{0,160}?[\])]\s*")
    first_doi = "coalesce({0}[1], {1}[1], '')".format(dois("raw"), dois("cleaned"))
    shape = f"title, {joined('authors')} AS authors, year, {first_doi} AS doi, isbn, '' AS arxiv, source, priority, notes"
    made = lambda title, authors_, year, source, priority, notes="''", isbn_="''", pos=0: f"doc_id, raw, cleaned, {pos} AS pos, {title} AS title, {authors_} AS authors, {year} AS year, {isbn_} AS isbn, '{source}' AS source, {priority} AS priority, {notes} AS notes"
    lone = f"(fits AND {journal_abbrev('pair_title')})"
    return f"""WITH s AS (SELECT doc_id, {raw} AS raw FROM ({rows})),
    c AS (SELECT *, {file_title('raw')} AS cleaned, list_filter(list_transform(regexp_split_to_array(raw, {text(r'\s+--\s+')}), lambda p: {clean('p')}), lambda p: p <> '' AND NOT {match('p', hex32)} AND NOT {match('p', archive)}) AS pieces FROM s),
    i AS (SELECT *, list_transform(pieces, lambda p: {isbn('p')}) AS isbns FROM c),
    j AS (SELECT *, coalesce(list_position(list_transform(isbns, lambda x: x <> ''), true), 0) AS ip, coalesce(list_position(list_transform(range(1, len(pieces) + 1), lambda k: {match('pieces[k]', '^(?:1[5-9][0-9]{2}|20[0-9]{2}|2100)$')} AND isbns[k] = ''), true), 0) AS yp FROM i),
    r AS MATERIALIZED (SELECT *, list_transform(list_filter(range(1, len(pieces) + 1), lambda k: k <> ip AND k <> yp), lambda k: {file_title('pieces[k]')}) AS rest, replace({leading}, '_', '; ') AS author, {meta_title(file_title(part(pair, 2)))} AS pair_title,
      coalesce(nullif({meta_year(file_title(part(pair, 2)))}, ''), {first_year('raw')}) AS pair_year, contains(raw, ' -- ') AS is_archive, {match('raw', series)} AS is_series, {match('raw', pair)} AS is_pair FROM j),
    f AS MATERIALIZED (SELECT *, NOT is_archive AND NOT is_series AND is_pair AND author <> '' AND length(pair_title) > 4 AS fits FROM r),
    made AS (SELECT {made(meta_title("coalesce(rest[1], '')"), f"CASE WHEN rest[2] IS NOT NULL AND NOT {match('rest[2]', hex32)} THEN {names('rest[2]')} ELSE [] END", either("coalesce(pieces[nullif(yp, 0)], '')", meta_year("coalesce(rest[1], '')")), 'filename_structured', 40, "'parsed structured Anna/libgen filename'", "coalesce(isbns[nullif(ip, 0)], '')")} FROM f WHERE is_archive
      UNION ALL SELECT {made(meta_title(file_title(part(series, 3))), names(clean(part(series, 2))), either(meta_year(file_title(part(series, 3))), part(series, 4)), 'filename_series', 35)} FROM f WHERE is_series AND NOT is_archive
      UNION ALL SELECT {made('pair_title', split_authors('author'), 'pair_year', 'filename_author_title', 45)} FROM f WHERE fits AND NOT {lone}
      UNION ALL SELECT {made("''", split_authors('author'), 'pair_year', 'filename_author_only', 70, "'filename title was journal abbreviation, dropped'")} FROM f WHERE {lone}
      UNION ALL SELECT {made(meta_title('cleaned'), '[]::varchar[]', either(meta_year('cleaned'), first_year('raw')), 'filename_title_only', 80, pos='CASE WHEN fits THEN 1 ELSE 0 END')} FROM f WHERE NOT is_archive AND NOT is_series AND (NOT fits OR {lone}))
    SELECT doc_id, pos, {shape} FROM made"""


def small_first(x: str) -> str:
    return f"concat(lower(substr({x}, 1, 1)), substr({x}, 2))"


def halves_joined(x: str, letters: str) -> str:
    """Of ASCII text."""
    met = f"list_transform(regexp_extract_all({x}, '\\b[B-HJ-Z]\\s+[A-Z][a-z]{letters}\\b'), lambda m: concat(substr(m, 1, 1), {small_first("trim(substr(m, 2), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}))"
    gaps = f"regexp_split_to_array({x}, '\\b[B-HJ-Z]\\s+[A-Z][a-z]{letters}\\b')"
    return f"array_to_string(list_transform({gaps}, lambda g, i: concat(g, coalesce({met}[i], ''))), '')"


def fragments_joined(x: str) -> str:
    """One round, of ASCII text."""
    whole = r"\b[A-Za-z][a-z]{1,4}\s+[A-Z][a-z]{2,}\b"
    first, second = (f"regexp_extract(m, '^(\\S+)\\s+(\\S+)$', {k})" for k in (1, 2))
    met = f"list_transform({found0(x, whole)}, lambda m: CASE WHEN list_contains({lst(repair.STAY_APART)}, lower({first})) THEN m ELSE concat({first}, {small_first(second)}) END)"
    return f"array_to_string(list_transform(regexp_split_to_array({x}, {text(whole)}), lambda g, i: concat(g, coalesce({met}[i], ''))), '')"


def found0(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {text(pattern)})"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform({found0(x, r'\pL+|\PL+')}, lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), '')"


def kept_lines(x: str) -> str:
    ends = text(r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    lines = f"list_filter(list_transform(regexp_split_to_array({x}, {ends}), lambda l: {clean('l')}), lambda l: l <> '')[1:{extract.KEPT_LINES}]"
    named = f"list_transform({lines}, lambda l: CASE WHEN lower(l) LIKE 'author(s):%' THEN trim(substr(l, 11)) WHEN NOT {noise('l')} THEN l END)"
    return f"list_filter({named}, lambda l: l IS NOT NULL)"


def line_fits(x: str) -> str:
    """Whether a line can be a title (conference lines are noise and never come here)."""
    capitals = match(x, extract.CAPITALS.replace(r"\z", "$"))
    n = f"len(string_split({x}, ' '))"
    spaced = f"len(list_filter(string_split({x}, ' '), lambda w: {match('w', r'^\pL$')})) > 0.4 * {n}"
    prose = f"({n} >= 3 AND NOT {match(x, extract.LONE_YEAR.replace(r'\z', '$'))} AND NOT lower({x}) LIKE 'proceedings%')"
    return f"(length({x}) BETWEEN 6 AND 220 AND NOT {journal_header(x)} AND CASE WHEN {capitals} THEN NOT {spaced} ELSE {prose} END)"


def capitals(x: str) -> str:
    return f"({match(x, r'\pL')} AND length({sub(x, r'[^\pL]|\p{Lu}')}) = 0 AND NOT contains({x}, ',') AND NOT {match(x, r'\b[A-Z]\.\s')} AND len(string_split({x}, ' ')) >= 2)"


# similarity of titles


def similar(pairs: str) -> str:
    """A table (a, b, sim) of the distinct title pairs of a query (a, b): the larger of sequence ratio and word Jaccard.

    The ratio is that of matching blocks: in each pair of stretches the longest common run is taken (the first of several, in a and
    then in b), and what stands before and behind it is searched in turn. Runs are islands of equal characters on a diagonal.
    """
    jac = jaccard("x", "y")
    return f"""(WITH RECURSIVE named AS MATERIALIZED (SELECT a, b, {title("a")} AS x, {title("b")} AS y FROM (SELECT DISTINCT a, b FROM ({pairs}))),
    p AS MATERIALIZED (SELECT row_number() OVER () AS id, x, y FROM (SELECT DISTINCT x, y FROM named WHERE x <> y AND x <> '' AND y <> '')),
    xs AS MATERIALIZED (SELECT id, i, substr(x, i, 1) AS c FROM (SELECT id, x, unnest(range(1, length(x) + 1)) AS i FROM p)),
    ys AS MATERIALIZED (SELECT id, j, substr(y, j, 1) AS c FROM (SELECT id, y, unnest(range(1, length(y) + 1)) AS j FROM p)),
    eq AS MATERIALIZED (SELECT id, i, j, i - j AS d FROM xs JOIN ys USING (id, c)),
    part AS (
      SELECT id, 1 AS x1, length(x) + 1 AS x2, 1 AS y1, length(y) + 1 AS y2, 0 AS k FROM p
      UNION ALL
      SELECT id, u.x1, u.x2, u.y1, u.y2, u.k FROM (
        SELECT id, unnest([struct_pack(x1 := x1, x2 := m.i, y1 := y1, y2 := m.j, k := -m.n), struct_pack(x1 := m.i - m.n, x2 := x2, y1 := m.j - m.n, y2 := y2, k := 0)]) AS u FROM (
          SELECT id, x1, x2, y1, y2, min(struct_pack(n := -k, i := i, j := j)) AS m FROM (
            SELECT id, x1, x2, y1, y2, min(i) AS i, min(j) AS j, count(*) AS k FROM (
              SELECT s.id, x1, x2, y1, y2, i, j, d, i - row_number() OVER (PARTITION BY s.id, x1, y1, d ORDER BY i) AS isle
              FROM part s JOIN eq ON eq.id = s.id AND i >= x1 AND i < x2 AND j >= y1 AND j < y2 WHERE x1 < x2 AND y1 < y2)
            GROUP BY id, x1, x2, y1, y2, d, isle)
          GROUP BY id, x1, x2, y1, y2))
    ),
    ratios AS (SELECT x, y, 2.0 * sum(k) / (length(x) + length(y)) AS ratio FROM p JOIN part USING (id) GROUP BY p.id, x, y)
    SELECT a, b, CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0 ELSE greatest(coalesce(ratio, 0.0), {jac}) END AS sim FROM named LEFT JOIN ratios USING (x, y))"""
