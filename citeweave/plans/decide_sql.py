"""The decision rules and the end-to-end job once more as DuckDB SQL, for the queries' counterparts.

Each function takes the names of tables of results (r) and candidates (c) with list columns, and gives a query. ``BASE`` makes those
tables from the driver's tables.
"""

from __future__ import annotations

from citeweave.functions.sanity import IDENTIFIER_SOURCES, SEARCH_SOURCES, STOP_WORDS
from citeweave.operators import decide
from citeweave.operators.search import LEAST, QUERIES, WAVES
from citeweave.plans import ducksql as d
from citeweave.plans import inputs as src


def one_of(x: str, values) -> str:
    return f"{x} IN ({', '.join(map(d.text, values))})"


def model(x: str) -> str:
    return f"({x} LIKE 'llm:%' OR {x} LIKE 'vision\\_llm:%' ESCAPE '\\')"


def overlap(a: str, b: str) -> str:
    """Of two lists of surnames."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"


def prefix(short: str, long: str) -> str:
    return f"(len({short}) > 0 AND len({short}) < len({long}) AND {long}[1:len({short})] = {short})"


def _ordered(x: str) -> str:
    """Distinct sources of a list of struct(p, s) that is in order."""
    s = f"list_transform(coalesce({x}, []), lambda e: e.s)"
    return f"list_filter({s}, lambda e, i: list_position({s}, e) = i)"


def sources(condition: str) -> str:
    return _ordered(f"list(struct_pack(p := c_pos, s := c_source) ORDER BY c_pos, c_source) FILTER (WHERE {condition})")


MENTIONS, CATALOG, CANDIDATES = (f"({src.oracle(x)})" for x in (src.MENTIONS, src.CATALOG, src.CANDIDATES))
_ISBNS = f"list_transform({d.found('text', r'[^0-9]((?:97[89][-\s]?)?[0-9][0-9\s-]{8,20}[0-9Xx])[^0-9]')}, lambda i: {d.isbn('i')})"
_ARXIVS = d.found("text", r"(?i)arXiv: ([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)\b")
#: m: documents; c: candidates; cat: catalog; hits: matched identifiers with their place in the pool; best: the winner of each document.
def base(mentions: str = MENTIONS, candidates: str = CANDIDATES, staged: str = "") -> str:
    return f"""
m AS MATERIALIZED (SELECT * FROM {mentions} AS t),
c AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, {d.words(d.title('title'))} AS tw FROM (SELECT doc_id, {staged}pos, title, {d.split_names('authors')} AS names, year, doi, isbn, arxiv, source, priority, {d.split_names('notes')} AS notes FROM {candidates} AS t)),
cat AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, CASE source WHEN 'crossref_doi' THEN 'doi' WHEN 'openlibrary_isbn' THEN 'isbn' ELSE 'arxiv' END AS kind, CASE source WHEN 'crossref_doi' THEN lower(doi) WHEN 'openlibrary_isbn' THEN isbn ELSE arxiv END AS key FROM (SELECT *, {d.split_names('authors')} AS names FROM {CATALOG} AS t)),
pool AS (SELECT doc_id, kind, value, min(n) AS pos FROM (
  SELECT doc_id, 'doi' AS kind, unnest({d.dois('text')}) AS value, generate_subscripts({d.dois('text')}, 1) AS n FROM m
  UNION ALL SELECT doc_id, 'doi', doi, 1000 + pos FROM c WHERE doi <> '' AND doc_id IN (SELECT doc_id FROM m)
  UNION ALL SELECT doc_id, 'isbn', unnest({_ISBNS}), generate_subscripts({_ISBNS}, 1) FROM m
  UNION ALL SELECT doc_id, 'arxiv', unnest({_ARXIVS}), generate_subscripts({_ARXIVS}, 1) FROM m) WHERE value <> '' GROUP BY 1, 2, 3),
hits AS (SELECT p.doc_id, p.kind, p.pos, p.value, k.title, k.names, k.sn, k.year, k.doi, k.isbn, k.arxiv, k.source, k.publisher FROM pool p JOIN cat k ON p.kind = k.kind AND k.key = CASE WHEN p.kind = 'doi' THEN lower(p.value) ELSE p.value END),
f AS MATERIALIZED (SELECT doc_id, {d.sanity('substr(text, 1, 8000)')} AS norm, {d.words(d.filename('path'))} AS name_words, length({d.strip('text')}) < 100 AS short, {d.unreadable('text')} AS blind FROM m),
scored AS MATERIALIZED (SELECT h.*, round({d.sanity_score('h.title', 'h.names', 'h.source', 'f.norm', 'f.name_words', 'f.short', 'f.blind')}, 3) AS sanity_score FROM hits h JOIN f USING (doc_id)),
best AS MATERIALIZED (SELECT *, sanity_score >= 0.4 AS sanity_passed FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sanity_score < 0.4, CASE WHEN sanity_score >= 0.4 THEN 0 ELSE -sanity_score END,
  CASE kind WHEN 'doi' THEN 0 WHEN 'isbn' THEN 1 ELSE 2 END, pos) = 1),
r AS MATERIALIZED (SELECT doc_id, title, names, sn, year, doi, isbn, arxiv, CASE WHEN doc_id % 3 = 0 THEN 'crossref_search' ELSE source END AS source, sanity_passed AND doc_id % 3 <> 0 AS sanity_passed, sanity_score,
  doc_id % 5 = 0 AS needs_ocr, false AS auto_safe, true AS verified, 'high' AS confidence, []::varchar[] AS notes FROM best)
"""


BASE = base()


def based(query: str) -> str:
    """A query over the tables of ``BASE``; one that starts with a comma adds tables of its own."""
    return f"WITH {BASE.strip()}{query if query.startswith(',') else ' ' + query}"


def evidence(r: str, c: str, where: str = "true") -> str:
    """Candidates with a title beside their document's result, and their similarity."""
    both = (
        f"SELECT c.doc_id, c.pos AS c_pos, c.source AS c_source, c.title AS c_title, c.year AS c_year, c.doi AS c_doi, c.isbn AS c_isbn, c.arxiv AS c_arxiv, c.sn AS c_sn, len(c.names) AS c_n, c.tw AS c_tw, "
        f"r.title AS r_title, {d.strip('r.title')} AS r_bare, r.year AS r_year, r.doi AS r_doi, r.isbn AS r_isbn, r.arxiv AS r_arxiv, r.source AS r_source, r.sanity_passed AS r_passed, r.sn AS r_sn, len(r.names) AS r_n, {d.words(d.title(d.strip('r.title')))} AS r_tw "
        f"FROM {c} c JOIN {r} r USING (doc_id) WHERE {where}"
    )
    return f"(WITH e AS MATERIALIZED ({both}) SELECT e.*, sim FROM e LEFT JOIN {d.similar('SELECT c_title AS a, r_bare AS b FROM e')} s ON s.a = e.c_title AND s.b = e.r_bare)"


def soft_auto(r: str = "r", c: str = "c") -> str:
    """(doc_id, soft_auto, soft_auto_reasons)."""
    t = d.strip("title")
    fit = f"(SELECT * FROM {r} WHERE NOT auto_safe AND length({t}) >= 5 AND NOT {d.garbage(t)} AND NOT {d.journal_abbrev(t)} AND NOT {d.suspicious(t)})"
    rows = evidence(fit, c, f"({one_of('c.source', decide.SOFT)} OR {model('c.source')}) AND c.title <> ''")
    agrees = f"(r_n > 0 AND c_n > 0 AND {overlap('c_sn', 'r_sn')} > 0)"
    return (
        f"WITH k AS (SELECT doc_id, c_source, min(c_pos) AS c_pos, arg_min({agrees}, c_pos) AS agrees FROM {rows} WHERE sim >= 0.7 OR (len(c_tw) >= 4 AND {prefix('c_tw', 'r_tw')}) GROUP BY 1, 2), "
        "s AS (SELECT doc_id, list(c_source ORDER BY c_pos, c_source) AS t, coalesce(list(c_source ORDER BY c_source) FILTER (WHERE agrees), []) AS a FROM k GROUP BY 1), "
        f"j AS (SELECT r.*, t, a, coalesce(len(t) >= CASE WHEN needs_ocr THEN 3 ELSE 2 END AND len(a) > 0, false) AS soft FROM {r} r LEFT JOIN s USING (doc_id)) "
        "SELECT doc_id, soft AS soft_auto, CASE WHEN soft THEN concat(CASE WHEN needs_ocr THEN '[needs-ocr threshold] ' ELSE '' END, 'title corroborated by ', len(t), ' strong sources (', array_to_string(t, ', '), '); authors corroborated by ', array_to_string(a, ', ')) ELSE '' END AS soft_auto_reasons FROM j"
    )


def corroboration(r: str = "r", c: str = "c") -> str:
    """(doc_id, strict_source, strict_similarity, accepted, source, note, force_review)."""
    same = " OR ".join(f"(r_{k} <> '' AND c_{k} = r_{k})" for k in ("isbn", "doi", "arxiv"))
    streamed = "(c_source = 'text_header' OR c_source LIKE 'llm:%')"
    counts = f"(({one_of('c_source', decide.CORROBORATING)} OR {model('c_source')}) AND NOT (doc_id IN (SELECT doc_id FROM e WHERE ({same}) AND {streamed}) AND {streamed}) AND c_title <> '' AND c_n > 0 AND r_n > 0 AND r_bare <> '' AND {overlap('r_sn', 'c_sn')} > 0)"
    subset = f"({one_of('r_source', IDENTIFIER_SOURCES)} AND r_passed AND {d.distinctive('r_title')} AND {prefix('r_tw', 'c_tw')} AND c_year IN ('', r_year))"
    strong = f"({one_of('c_source', decide.SUBSET_STRONG)} OR {model('c_source')})"
    return (
        f"WITH e AS MATERIALIZED (SELECT * FROM {evidence(r, c)}), k AS (SELECT *, {subset} AS subset FROM e WHERE {counts}), "
        f"s AS (SELECT doc_id, arg_max(c_source, struct_pack(s := sim, p := -c_pos)) FILTER (WHERE sim >= 0.7) AS ss, max(sim) FILTER (WHERE sim >= 0.7) AS top, {sources(f'subset AND {strong}')} AS st, {sources(f'subset AND NOT {strong}')} AS wk FROM k GROUP BY 1), "
        f"j AS (SELECT r.doc_id, ss, top, coalesce(st, []) AS st, coalesce(wk, []) AS wk, {d.distinctive('r.title')} AS own FROM {r} r LEFT JOIN s USING (doc_id)), "
        "n AS (SELECT *, array_to_string(list_concat(st, list_filter(wk, lambda w: NOT list_contains(st, w))), ', ') AS named FROM j) "
        "SELECT doc_id, coalesce(ss, '') AS strict_source, round(coalesce(top, 0), 6) AS strict_similarity, ss IS NOT NULL OR len(st) > 0 OR len(wk) > 0 AS accepted, coalesce(ss, st[1], wk[1], '') AS source, "
        "CASE WHEN ss IS NOT NULL THEN CASE WHEN own THEN '' ELSE concat('accepted for review via generic-title corroboration by ', ss) END WHEN len(st) > 0 THEN concat('identifier main-title corroborated by ', named) "
        "WHEN len(wk) > 0 THEN concat('accepted for review via main-title corroboration by ', named) ELSE '' END AS note, CASE WHEN ss IS NOT NULL THEN NOT own ELSE len(st) = 0 AND len(wk) > 0 END AS force_review FROM n"
    )


def rescue(r: str = "r", c: str = "c") -> str:
    """The columns of r, with sanity_passed, sanity_score and notes changed."""
    due = f"(SELECT * FROM {r} WHERE NOT sanity_passed AND verified AND {one_of('source', SEARCH_SOURCES)})"
    rows = evidence(due, c, f"({one_of('c.source', decide.RESCUING)} OR {model('c.source')}) AND c.title <> ''")
    full = f"((r_n > 0 AND c_n > 0 AND {overlap('r_sn', 'c_sn')} >= 0.5) OR (r_year <> '' AND c_year = r_year))"
    return (
        f"WITH s AS (SELECT doc_id, {sources(full)} AS full_by, {sources('true')} AS titled FROM {rows} WHERE sim >= 0.97 GROUP BY 1), "
        f"j AS (SELECT r.*, CASE WHEN len(full_by) > 0 THEN concat('locally corroborated despite unreadable text via ', array_to_string(full_by, ', ')) "
        f"WHEN len(titled) >= 2 AND len({d.words(d.title('title'))}) >= 4 THEN concat('title corroborated by multiple local extractors despite unreadable text via ', array_to_string(titled, ', ')) END AS saved FROM {r} r LEFT JOIN s USING (doc_id)) "
        "SELECT * EXCLUDE (saved) REPLACE (sanity_passed OR saved IS NOT NULL AS sanity_passed, CASE WHEN saved IS NULL THEN sanity_score ELSE greatest(sanity_score, 0.6) END AS sanity_score, CASE WHEN saved IS NULL THEN notes ELSE list_append(notes, saved) END AS notes) FROM j"
    )


def downgraded(r: str) -> str:
    said = "concat('sanity_score=', printf('%.3f', sanity_score), CASE WHEN sanity_passed THEN ' (passed)' ELSE ' (below threshold 0.4)' END)"
    return f"SELECT * REPLACE (verified AND sanity_passed AS verified, CASE WHEN NOT sanity_passed AND confidence = 'high' THEN 'medium' ELSE confidence END AS confidence, list_append(notes, {said}) AS notes) FROM {r}"


_NT = f"len({d.words(d.title('title'))})"
QUALITY = (
    f"(CASE WHEN title = '' THEN 0.0 WHEN {d.garbage('title')} THEN -3.0 WHEN {d.journal_abbrev('title')} THEN -2.0 ELSE least(4.0, greatest(1.0, {_NT} / 3.0)) END "
    "+ CASE WHEN len(names) > 0 THEN least(2.0, 0.75 + 0.5 * len(names)) ELSE 0 END + CASE WHEN year <> '' THEN 0.4 ELSE 0 END + CASE WHEN doi <> '' OR isbn <> '' OR arxiv <> '' THEN 2.5 ELSE 0 END "
    "- CASE WHEN source IN ('filename_title_only', 'text_header') THEN 0.8 ELSE 0 END - CASE WHEN source = 'pdfinfo' AND (title LIKE 'PII:%' OR title = '') THEN 1.5 ELSE 0 END "
    f"- CASE WHEN title <> '' AND {_NT} <= 2 THEN 0.5 ELSE 0 END)"
)
USEFUL = "(title <> '' OR len(names) > 0 OR doi <> '' OR isbn <> '' OR arxiv <> '')"
RANK = "round(quality, 9) DESC, priority, length(title) DESC, pos"


def fallback(docs: str, c: str = "c") -> str:
    """(doc_id, title, names, year, ids, source, confidence, notes) of each document of ``docs``."""
    odd = "(b.source = 'pdfinfo' AND b.title LIKE 'PII:%')"
    return (
        f"WITH b AS (SELECT * FROM (SELECT *, {QUALITY} AS quality FROM {c}) WHERE {USEFUL} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {RANK}) = 1) "
        f"SELECT d.doc_id, coalesce(b.title, '') AS title, CASE WHEN b.source IS NULL THEN [] ELSE {d.authors('b.names')} END AS names, coalesce(b.year, '') AS year, coalesce(b.doi, '') AS doi, coalesce(b.isbn, '') AS isbn, coalesce(b.arxiv, '') AS arxiv, "
        f"coalesce(b.source, 'none') AS source, CASE WHEN b.source IS NULL OR b.source IN ('filename_title_only', 'text_header') OR {odd} THEN 'low' ELSE 'medium' END AS confidence, "
        f"CASE WHEN b.source IS NULL THEN ['no metadata extracted'] ELSE list_concat(list_concat(b.notes, CASE WHEN {odd} THEN ['pdfinfo title looks like a publisher internal ID'] ELSE [] END), ['best local guess; external verification failed']) END AS notes FROM {docs} d LEFT JOIN b USING (doc_id)"
    )


def prefer_local(r: str, local: str) -> str:
    """The columns of r where a local row takes the place of an unlike match."""
    due = f"(NOT r.sanity_passed AND NOT r.verified AND {one_of('r.source', SEARCH_SOURCES)} AND coalesce(l.title, '') <> '' AND NOT {d.too_generic('l.title', 'len(l.names)', 'l.year')})"
    swap = f"({due} AND NOT (r.title <> '' AND sim >= 0.5))"
    kept = "list_append(l.notes, concat('rejected conflicting external match from ', r.source))"
    distinct = f"list_filter(r.notes, lambda n, i: NOT list_contains({kept}, n) AND list_position(r.notes, n) = i)"
    fields = ("title", "names", "year", "doi", "isbn", "arxiv", "source", "confidence")
    return (
        f"SELECT r.* REPLACE ({', '.join(f'CASE WHEN {swap} THEN l.{k} ELSE r.{k} END AS {k}' for k in fields)}, NOT {swap} AND r.verified AS verified, CASE WHEN {swap} THEN 0.0 ELSE r.sanity_score END AS sanity_score, "
        f"CASE WHEN {swap} THEN list_concat({kept}, {distinct}) ELSE r.notes END AS notes), {swap} AS swapped FROM {r} r LEFT JOIN {local} l USING (doc_id) LEFT JOIN {d.similar(f'SELECT r.title AS a, l.title AS b FROM {r} r JOIN {local} l USING (doc_id)')} s ON s.a = r.title AND s.b = l.title"
    )


def merged(r: str, local: str) -> str:
    """The columns of r, blanks filled from the local row, whose notes follow."""
    scalars = ", ".join(f"coalesce(nullif(r.{k}, ''), l.{k}, '') AS {k}" for k in ("title", "year", "doi", "isbn", "arxiv"))
    return f"SELECT r.* REPLACE ({scalars}, CASE WHEN len(r.names) > 0 THEN r.names ELSE coalesce(l.names, []) END AS names, list_concat(r.notes, coalesce(l.notes, [])) AS notes) FROM {r} r LEFT JOIN {local} l USING (doc_id)"


_TO_SEARCH = "CASE source WHEN 'crossref_doi' THEN CASE WHEN length(title) % 2 = 0 THEN 'crossref_search' ELSE 'openalex_search' END WHEN 'openlibrary_isbn' THEN 'openlibrary_search' ELSE 'semanticscholar_search' END"
_THRESHOLD = "CASE k.source " + " ".join(f"WHEN '{s}' THEN {t}" for s, (_, t) in WAVES.items()) + " END"
_ORDER = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(WAVES)) + " END"
_WAVE = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, (w, _) in WAVES.items()) + " END"
BAND = "CASE WHEN score >= 0.97 THEN 'high' WHEN score >= 0.9 THEN 'medium' ELSE 'low' END"
SCORE = f"sim + CASE WHEN len(q.names) > 0 AND {overlap('q.sn', 'k.sn')} >= 0.5 THEN 0.05 ELSE 0 END + CASE WHEN q.year <> '' AND q.year = k.year THEN 0.05 ELSE 0 END"


def _rarest(part: str) -> str:
    return f"row_number() OVER (PARTITION BY {part} ORDER BY df, token) <= count(*) OVER (PARTITION BY {part}) - ceil(count(*) OVER (PARTITION BY {part}) * {LEAST} - 1e-9) + 1"


def searched(docs: str, c: str = "c", f: str = "f") -> str:
    """Best search match of each document of ``docs`` (search by words): the columns of hits, nth, score, confidence, total."""
    before = "SELECT 1 FROM h e WHERE e.doc_id = h.doc_id AND e.source = h.source AND e.nth < h.nth AND e.strong"
    best = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, ord, nth) = 1"
    return f"""WITH q AS MATERIALIZED (SELECT row_number() OVER () AS qid, * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, pos) AS nth FROM {c} WHERE doc_id IN (SELECT doc_id FROM {docs}) AND {d.searchable('title', 'len(names)', 'year')}) WHERE nth <= {QUERIES}),
    k AS MATERIALIZED (SELECT row_number() OVER () AS eid, * REPLACE ({_TO_SEARCH} AS source) FROM cat),
    kt AS MATERIALIZED (SELECT eid, unnest(list_distinct({d.words(d.title('title'))})) AS token FROM k),
    qt AS (SELECT qid, t.token, list_contains({d.lst(STOP_WORDS)}, t.token) AS stop, coalesce(n, 0) AS df FROM (SELECT qid, unnest(list_distinct({d.words(d.title('title'))})) AS token FROM q) t LEFT JOIN (SELECT token, count(*) AS n FROM kt GROUP BY 1) USING (token)),
    pick AS (SELECT qid, token FROM (SELECT *, {_rarest('qid')} AS a, {_rarest('qid, stop')} AND NOT stop AS b FROM qt) WHERE (a OR b) AND df > 0),
    pairs AS (SELECT DISTINCT qid, eid FROM pick JOIN kt USING (token) UNION SELECT qid, eid FROM (SELECT qid, {d.title('title')} AS x FROM q) a JOIN (SELECT eid, {d.title('title')} AS x FROM k) b USING (x) WHERE x <> ''),
    met AS MATERIALIZED (SELECT qid, eid, q.title AS a, k.title AS b FROM pairs JOIN q USING (qid) JOIN k USING (eid)),
    s AS (SELECT q.doc_id, q.nth, q.qid, k.source, k.title, k.names, k.sn, k.year, k.doi, k.isbn, k.arxiv, k.publisher, {SCORE} AS score, {_THRESHOLD} AS least FROM met JOIN {d.similar('SELECT a, b FROM met')} USING (a, b) JOIN q USING (qid) JOIN k USING (eid)),
    top AS (SELECT *, {BAND} AS confidence FROM s WHERE score >= least QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC) = 1),
    h AS MATERIALIZED (SELECT *, sanity_score >= 0.4 AS sanity_passed, sanity_score >= 0.4 AND confidence = 'high' AS strong, sanity_score + CASE WHEN confidence = 'high' THEN 0.05 ELSE 0 END AS total, {_ORDER} AS ord, {_WAVE} AS wave FROM (
      SELECT top.*, round({d.sanity_score('top.title', 'top.names', 'top.source', 'f.norm', 'f.name_words', 'f.short', 'f.blind')}, 3) AS sanity_score FROM top JOIN {f} f USING (doc_id))),
    t AS (SELECT * FROM h WHERE NOT EXISTS ({before})),
    w1 AS (SELECT * FROM t WHERE wave = 1 {best}),
    w2 AS (SELECT * FROM (SELECT * FROM w1 UNION ALL SELECT * FROM t WHERE wave = 2 AND doc_id NOT IN (SELECT doc_id FROM w1 WHERE strong)) {best}),
    w3 AS (SELECT * FROM (SELECT * FROM w2 UNION ALL SELECT * FROM t WHERE wave = 3 AND doc_id NOT IN (SELECT doc_id FROM w2 WHERE strong)) {best})
    SELECT * FROM w3"""


SHAPE = "doc_id, title, names, sn, year, doi, isbn, arxiv, publisher, source, confidence, verified, sanity_passed, sanity_score, needs_ocr, notes, note"
NOTE = "CASE kind WHEN 'doi' THEN 'resolved by DOI via Crossref' WHEN 'isbn' THEN 'resolved by ISBN via OpenLibrary' ELSE 'resolved by arXiv ID' END"
WITH_WHY = "concat(note, ' (', CASE WHEN why <> '' THEN why ELSE concat('corroborated by ', by_source) END, ')')"


def _noted(r: str) -> str:
    """The columns of r, its note behind its notes."""
    return f"SELECT * REPLACE (CASE WHEN note <> '' THEN list_append(notes, note) ELSE notes END AS notes) FROM ({r})"


def concluded(sure: str, opened: str, held: str | None, looked: str, docs: str = "f", local: str = "local") -> str:
    """CTEs up to ``every`` and ``soft``, and the result rows, from tables of ``SHAPE`` (``sure`` with force_review) and the search's best matches."""
    lower = "CASE WHEN confidence = 'high' THEN 'medium' ELSE confidence END"
    passed = "concat('sanity_score=', printf('%.3f', sanity_score), ' (passed)')"
    clean = lambda r: f"(SELECT * REPLACE ({d.authors('names')} AS names) FROM {r})"
    keep = "doc_id, title, names, sn, year, doi, isbn, arxiv, publisher, source, {c} AS confidence, verified, sanity_passed, sanity_score, needs_ocr, notes"
    kept_for_review = ""
    if held:
        kept_for_review = f" UNION ALL SELECT {keep.format(c=lower)}, false, false FROM held_rows"
        held = f"held_rows AS (SELECT * REPLACE (list_concat(notes, ['no local extractor corroborated this identifier match; routed to review for human verification', {passed}]) AS notes) FROM ({_noted(merged(clean(f'(SELECT * FROM {held} WHERE doc_id NOT IN (SELECT doc_id FROM won))'), local))})),"
    return f"""sure_rows AS MATERIALIZED (SELECT * REPLACE (list_append(notes, {passed}) AS notes) FROM ({_noted(merged(clean(sure), local))})),
    rest AS (SELECT {SHAPE}, sanity_score AS rank, 0 AS o FROM {opened}
      UNION ALL SELECT doc_id, title, names, sn, year, doi, isbn, arxiv, publisher, source, confidence, true, sanity_passed, sanity_score, f.blind, []::varchar[], 'title-search match', total, 1 FROM {looked} JOIN {docs} f USING (doc_id)),
    top1 AS MATERIALIZED (SELECT {SHAPE} FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM sure_rows) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, o) = 1),
    filled AS MATERIALIZED (SELECT * REPLACE ({d.surnames('names')} AS sn) FROM ({_noted(merged('top1', local))})),
    saved AS MATERIALIZED ({rescue('filled', 'k')}), lowered AS MATERIALIZED ({downgraded('saved')}),
    won AS MATERIALIZED (SELECT * REPLACE (CASE WHEN swapped THEN '' ELSE publisher END AS publisher) FROM ({prefer_local('lowered', local)})), {held or ""}
    decided AS MATERIALIZED (SELECT {keep.format(c=f"CASE WHEN force_review THEN {lower} ELSE confidence END")}, NOT force_review AND verified AND confidence = 'high' AS auto_safe, NOT force_review AS judge FROM sure_rows
      UNION ALL SELECT {keep.format(c="confidence")}, verified AND sanity_passed AND confidence = 'high', true FROM won{kept_for_review}),
    every AS MATERIALIZED (SELECT * REPLACE ({d.surnames('names')} AS sn) FROM (SELECT * FROM decided UNION ALL
      SELECT doc_id, title, names, []::varchar[], year, doi, isbn, arxiv, '', source, confidence, false, false, 0.0, f.blind, CASE WHEN f.blind THEN list_append(notes, 'PDF text appears unreadable — OCR recommended') ELSE notes END, false, true FROM {local} JOIN {docs} f USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM decided))),
    soft AS ({soft_auto('every', 'k')})
    SELECT doc_id, title, array_to_string(names, ' | ') AS authors, year, doi, isbn, arxiv, publisher, source, confidence, verified, sanity_passed, round(sanity_score, 3) AS sanity_score, needs_ocr, auto_safe, array_to_string(notes, ' | ') AS notes, judge AND soft.soft_auto AS soft_auto FROM every JOIN soft USING (doc_id)"""


def finalized(mode: str = "default") -> str:
    """One result a document."""
    ident = f"SELECT doc_id, title, names, sn, year, doi, isbn, arxiv, publisher, source, 'high' AS confidence, true AS verified, sanity_passed, sanity_score, blind AS needs_ocr, []::varchar[] AS notes, {NOTE} AS note FROM best JOIN f USING (doc_id)"
    if mode == "safe":
        judged = f"judged AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN accepted THEN {WITH_WHY} ELSE p.note END AS note), accepted, force_review FROM (SELECT * FROM ident WHERE sanity_passed) p JOIN (SELECT doc_id, accepted, force_review, source AS by_source, note AS why FROM ({corroboration('(SELECT * FROM ident WHERE sanity_passed)')})) s USING (doc_id)),"
    else:
        judged = "judged AS (SELECT *, true AS accepted, false AS force_review FROM ident WHERE sanity_passed),"
    return based(
        f""", k AS (SELECT * FROM c), ident AS MATERIALIZED ({ident}), local AS MATERIALIZED ({fallback('m')}), {judged}
    looked AS MATERIALIZED ({searched('(SELECT doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM ident WHERE sanity_passed))')}),
    {concluded('(SELECT * FROM judged WHERE accepted)', '(SELECT * FROM ident WHERE NOT sanity_passed)', '(SELECT * FROM judged WHERE NOT accepted)' if mode == 'safe' else None, 'looked')}"""
    )


def _arriving(stage: int, docs: str) -> str:
    return f"SELECT * EXCLUDE (stage) FROM c WHERE stage = {stage} AND doc_id IN (SELECT doc_id FROM {docs})"


def _unseen(rows: str, known: str) -> str:
    """Rows whose key no row of ``known`` has, the first of each key."""
    key = "source, title, array_to_string(names, '; '), year, doi, isbn, arxiv"
    return f"SELECT * FROM ({rows}) WHERE (doc_id, {key}) NOT IN (SELECT doc_id, {key} FROM {known}) QUALIFY row_number() OVER (PARTITION BY doc_id, {key} ORDER BY pos) = 1"


def _combined(known: str, pos: int) -> str:
    made = f"SELECT doc_id, {pos} AS pos, title, {d.split_names('authors')} AS names, year, doi, isbn, arxiv, source, priority, ['combined local title/author/year candidates'] AS notes FROM ({synthesized(known)})"
    return _unseen(f"SELECT *, {d.surnames('names')} AS sn, {d.words(d.title('title'))} AS tw FROM ({made})", known)


def _round(k: int, safe: bool, f: str) -> str:
    """Tables of look-up round k: settled, best, held, open, tried, from those of the round before and the candidates k{k}."""
    before = k - 1
    rank = "sanity_score < 0.4, CASE WHEN sanity_score >= 0.4 THEN 0 ELSE -sanity_score END, korder, pos"
    match = f"SELECT h.doc_id, h.kind, h.value, h.pos, h.title, h.names, h.sn, h.year, h.doi, h.isbn, h.arxiv, h.source, h.publisher, 'high' AS confidence, true AS verified, sanity_score >= 0.4 AS sanity_passed, sanity_score, fl.blind AS needs_ocr, []::varchar[] AS notes, {NOTE} AS note"
    out = f"""
    pool{k} AS (SELECT doc_id, kind, value, min(n) AS pos FROM (SELECT * FROM text_pool UNION ALL SELECT doc_id, 'doi', doi, 1000 + pos FROM k{k} WHERE doi <> '') WHERE value <> '' AND doc_id IN (SELECT doc_id FROM open{before}) GROUP BY 1, 2, 3),
    hit{k} AS (SELECT p.doc_id, p.kind, p.pos, p.value, CASE p.kind WHEN 'doi' THEN 0 WHEN 'isbn' THEN 1 ELSE 2 END AS korder, e.title, e.names, e.sn, e.year, e.doi, e.isbn, e.arxiv, e.source, e.publisher FROM pool{k} p JOIN cat e ON p.kind = e.kind AND e.key = CASE WHEN p.kind = 'doi' THEN lower(p.value) ELSE p.value END
      WHERE (p.doc_id, p.kind, p.value) NOT IN (SELECT doc_id, kind, value FROM tried{before})),
    scored{k} AS MATERIALIZED (SELECT h.*, round({d.sanity_score('h.title', 'h.names', 'h.source', 'f.norm', 'f.name_words', 'f.short', 'f.blind')}, 3) AS sanity_score FROM hit{k} h JOIN {f} f USING (doc_id)),
    new{k} AS MATERIALIZED (SELECT * FROM scored{k} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {rank}) = 1),
    tried{k} AS MATERIALIZED (SELECT * FROM tried{before} UNION ALL SELECT s.doc_id, s.kind, s.value FROM scored{k} s LEFT JOIN (SELECT * FROM new{k} WHERE sanity_score >= 0.4) w USING (doc_id) WHERE w.doc_id IS NULL OR s.korder < w.korder OR (s.korder = w.korder AND s.pos <= w.pos)),
    both{k} AS MATERIALIZED (SELECT * EXCLUDE (o) FROM (SELECT *, 0 AS o FROM best{before} UNION ALL SELECT *, 1 FROM ({match} FROM new{k} h JOIN f fl USING (doc_id))) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sanity_score DESC, o) = 1),"""
    if not safe:
        return out + f"""
    settled{k} AS (SELECT *, false AS force_review FROM both{k} WHERE sanity_passed), best{k} AS (SELECT * FROM both{k} WHERE NOT sanity_passed),
    open{k} AS MATERIALIZED (SELECT doc_id FROM open{before} WHERE doc_id NOT IN (SELECT doc_id FROM settled{k})),"""
    return out + f"""
    said{k} AS MATERIALIZED (SELECT doc_id, accepted, force_review, source AS by_source, note AS why FROM ({corroboration(f'(SELECT * FROM both{k} WHERE sanity_passed)', f'k{k}')})),
    asked{k} AS MATERIALIZED (SELECT b.*, accepted, force_review, by_source, why, force_review AND doc_id NOT IN (SELECT doc_id FROM k{k} WHERE source = 'grobid' OR {model('source')}) AS waits FROM both{k} b LEFT JOIN said{k} USING (doc_id)),
    ended{k} AS (SELECT * REPLACE ({WITH_WHY} AS note) FROM asked{k} WHERE sanity_passed AND accepted AND NOT waits),
    hold{k} AS MATERIALIZED (SELECT * FROM (SELECT *, true AS old FROM held{before} UNION ALL SELECT * EXCLUDE (accepted, force_review, by_source, why, waits), false FROM asked{k} WHERE sanity_passed AND NOT accepted) WHERE doc_id NOT IN (SELECT doc_id FROM ended{k}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sanity_score DESC, NOT old) = 1),
    {_recheck(k, f"(SELECT * EXCLUDE (old) FROM hold{k} WHERE old)")}
    settled{k} AS MATERIALIZED (SELECT * EXCLUDE (accepted, by_source, why, waits) FROM ended{k} UNION ALL SELECT * FROM late{k}),
    open{k} AS MATERIALIZED (SELECT doc_id FROM open{before} WHERE doc_id NOT IN (SELECT doc_id FROM settled{k})),
    best{k} AS MATERIALIZED (SELECT * EXCLUDE (accepted, force_review, by_source, why, waits) FROM asked{k} WHERE doc_id IN (SELECT doc_id FROM open{k}) AND (NOT sanity_passed OR waits)),
    held{k} AS MATERIALIZED (SELECT * EXCLUDE (old) FROM hold{k} WHERE doc_id IN (SELECT doc_id FROM open{k})),"""


def _recheck(k: int, held: str) -> str:
    return f"""late{k} AS MATERIALIZED (SELECT h.* REPLACE ({WITH_WHY.replace('note', 'h.note', 1)} AS note), force_review FROM {held} h JOIN (SELECT doc_id, accepted, force_review, source AS by_source, note AS why FROM ({corroboration(held, f'k{k}')})) USING (doc_id) WHERE accepted),"""


def phased(mode: str = "default") -> str:
    """The rounds of the phased job over staged candidates, every decision made anew from all candidates: one result a document and the round that settled it."""
    safe = mode == "safe"
    docs, cands = (f"({src.oracle(x)})" for x in (src.STAGED_DOCS, src.STAGED))
    usable = f"title <> '' AND {_NT} >= 4 AND NOT {d.series('title')} AND ({one_of('source', decide.SEARCHABLE)} OR source LIKE 'llm:%')"
    numeric = d.match("regexp_extract(path, '([^/]*)\\.pdf$', 1)", "^[0-9]{7,10}$")
    strong = f"(NOT f.blind AND doc_id IN (SELECT doc_id FROM k2 WHERE {usable}))"
    if safe:
        call = f"NOT {strong} OR doc_id IN (SELECT doc_id FROM held2)"
    else:
        call = f"NOT (doc_id IN (SELECT doc_id FROM tried2) AND (doc_id IN (SELECT doc_id FROM pool2) OR {numeric})) AND NOT {strong}"
    columns = "source = 'grobid' AND doc_id IN (SELECT doc_id FROM books)"
    seen = "SELECT doc_id, string_agg(trim(concat(title, ' ', array_to_string(names, ' '))), ' ' ORDER BY pos) AS t FROM a3 WHERE doc_id IN (SELECT doc_id FROM m WHERE text = '') GROUP BY 1"
    empty = "SELECT * FROM ({}) WHERE false"
    last = 4 if safe else 3
    final = " UNION ALL ".join([f"SELECT * FROM k{i} WHERE doc_id IN (SELECT doc_id FROM settled{i})" for i in range(1, last + 1)] + [f"SELECT * FROM k{last} WHERE doc_id IN (SELECT doc_id FROM open{last})"])
    start = "SELECT doc_id, kind, value, pos, title, names, sn, year, doi, isbn, arxiv, source, publisher, 'high' AS confidence, true AS verified, true AS sanity_passed, sanity_score, false AS needs_ocr, []::varchar[] AS notes, '' AS note FROM best"
    phase_of = " UNION ALL ".join(f"SELECT doc_id, {i} AS phase FROM settled{i}" for i in range(1, last + 1))
    escalated = f"""
    a4 AS MATERIALIZED ({_unseen(_arriving(4, 'held3'), 'k3')}), k4a AS MATERIALIZED (SELECT * FROM k3 WHERE doc_id IN (SELECT doc_id FROM open3) UNION ALL SELECT * FROM a4),
    s4 AS MATERIALIZED ({_combined('(SELECT * FROM k4a WHERE doc_id IN (SELECT doc_id FROM held3))', 490000)}), k4 AS MATERIALIZED (SELECT * FROM k4a UNION ALL SELECT * FROM s4),
    {_recheck(4, 'held3')} settled4 AS (SELECT * FROM late4), open4 AS MATERIALIZED (SELECT doc_id FROM open3 WHERE doc_id NOT IN (SELECT doc_id FROM late4)),
    best4 AS (SELECT * FROM best3 WHERE doc_id IN (SELECT doc_id FROM open4)), held4 AS (SELECT * FROM held3 WHERE doc_id IN (SELECT doc_id FROM open4)),"""
    text_pool = base(docs, cands, "stage, ")
    text_pool = text_pool[text_pool.index("SELECT doc_id, 'doi' AS kind, unnest") : text_pool.index(") WHERE value <> '' GROUP BY")]
    text_pool = "\n  UNION ALL ".join(p for p in text_pool.split("\n  UNION ALL ") if "FROM c " not in p)
    return f"""WITH {base(docs, cands, 'stage, ').strip()}, text_pool AS MATERIALIZED ({text_pool}),
    open0 AS (SELECT doc_id FROM m), tried0 AS (SELECT doc_id, kind, value FROM pool WHERE false), best0 AS ({empty.format(start)}), held0 AS ({empty.format(start)}),
    books0 AS MATERIALIZED (SELECT doc_id FROM m WHERE {d.book('path', 'text')}),
    k1a AS MATERIALIZED ({_arriving(1, 'open0')}), s1 AS MATERIALIZED ({_combined('k1a', 190000)}), k1 AS MATERIALIZED (SELECT * FROM k1a UNION ALL SELECT * FROM s1),{_round(1, safe, 'f')}
    k2a AS MATERIALIZED (SELECT * FROM k1 WHERE doc_id IN (SELECT doc_id FROM open1) UNION ALL {_arriving(2, 'open1')}), s2 AS MATERIALIZED ({_combined('k2a', 290000)}), k2 AS MATERIALIZED (SELECT * FROM k2a UNION ALL SELECT * FROM s2),{_round(2, safe, 'f')}
    hard AS MATERIALIZED (SELECT doc_id FROM open2 JOIN m USING (doc_id) JOIN f USING (doc_id) WHERE {call}),
    a3 AS MATERIALIZED ({_unseen(_arriving(3, 'hard'), 'k2')}), k3a AS MATERIALIZED (SELECT * FROM k2 WHERE doc_id IN (SELECT doc_id FROM open2) UNION ALL SELECT * FROM a3),
    s3 AS MATERIALIZED ({_combined('k3a', 390000)}), books AS (SELECT doc_id FROM books0 WHERE doc_id IN (SELECT doc_id FROM open2)),
    k3b AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {columns} THEN greatest(priority, 30) ELSE priority END AS priority, CASE WHEN {columns} THEN list_append(notes, 'grobid demoted (is_book)') ELSE notes END AS notes) FROM (SELECT * FROM k3a UNION ALL SELECT * FROM s3)),
    s3b AS MATERIALIZED ({_combined('k3b', 391000)}), k3 AS MATERIALIZED (SELECT * FROM k3b UNION ALL SELECT * FROM s3b),
    f3 AS MATERIALIZED (SELECT doc_id, coalesce(norm2, norm) AS norm, name_words, coalesce(short2, short) AS short, coalesce(blind2, blind) AS blind FROM f LEFT JOIN (SELECT doc_id, {d.sanity('substr(t, 1, 8000)')} AS norm2, length({d.strip('t')}) < 100 AS short2, {d.unreadable('t')} AS blind2 FROM ({seen})) USING (doc_id)),{_round(3, safe, 'f3')}{escalated if safe else ''}
    k AS MATERIALIZED ({final}), local AS MATERIALIZED ({fallback('m', 'k')}), looked AS MATERIALIZED ({searched(f'open{last}', 'k', 'f3')}),
    sure AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM settled{i}' for i in range(1, last + 1))}), phases AS ({phase_of}),
    out AS ({concluded('sure', f'best{last}', f'held{last}' if safe else None, 'looked', 'f').replace('sure_rows AS', 'WITH sure_rows AS', 1)})
    SELECT out.*, coalesce(phase, 0)::INTEGER AS phase FROM out LEFT JOIN phases USING (doc_id)"""


def synthesized(c: str = "c") -> str:
    """(doc_id, title, authors, year, doi, isbn, arxiv, source, priority)."""
    good = f"(title <> '' AND NOT {d.garbage('title')} AND NOT {d.journal_abbrev('title')} AND NOT {d.suspicious('title')})"
    said = "CASE WHEN source LIKE 'llm:%' OR source LIKE 'vision\\_llm:%' ESCAPE '\\' THEN 4.0 WHEN source IN ('grobid', 'pdfinfo', 'pdf_metadata', 'xmp') THEN 3.0 WHEN source IN ('filename_author_title', 'filename_structured', 'filename_series') THEN 2.0 WHEN source = 'text_header' THEN 1.0 ELSE 0.0 END"
    by_author = f"({said} + least(1.0, 0.25 * len(names)) + CASE WHEN title <> '' THEN 0.5 ELSE 0 END + CASE WHEN year <> '' THEN 0.25 ELSE 0 END)"
    rank = "struct_pack(q := -round(quality, 9), p := priority, l := -length(title), n := pos)"
    fits = "(source <> 'synthesized' AND (title = '' OR sim >= 0.7))"
    of_author = (
        f"CASE WHEN {fits} THEN struct_pack(a := 0, q := -round({by_author}, 9), p := priority, l := 0, n := pos) ELSE struct_pack(a := CASE WHEN source <> 'synthesized' THEN 1 ELSE 2 END, q := -round(quality, 9), p := priority, l := -length(title), n := pos) END"
    )
    return f"""WITH a AS MATERIALIZED (SELECT *, {QUALITY} AS quality, {good} AS good FROM (SELECT * REPLACE ({d.authors('names')} AS names) FROM {c})),
    t AS MATERIALIZED (SELECT doc_id, title AS t_title, names AS t_names, year AS t_year, doi AS t_doi, isbn AS t_isbn, arxiv AS t_arxiv, priority AS t_priority FROM a WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT good, {RANK}) = 1),
    j AS MATERIALIZED (SELECT * FROM a JOIN t USING (doc_id) LEFT JOIN {d.similar('SELECT a.title AS a, t_title AS b FROM a JOIN t USING (doc_id)')} s ON s.a = title AND s.b = t_title),
    g AS (SELECT doc_id, any_value(t_title) AS title, coalesce(arg_min(names, {of_author}) FILTER (WHERE len(names) > 0), any_value(t_names)) AS names, coalesce(arg_min(year, {rank}) FILTER (WHERE year <> '' AND {USEFUL}), any_value(t_year)) AS year,
      {', '.join(f"coalesce(nullif(arg_min({k}, {rank}) FILTER (WHERE doi <> '' OR isbn <> '' OR arxiv <> ''), ''), any_value(t_{k})) AS {k}" for k in ('doi', 'isbn', 'arxiv'))}, least(any_value(t_priority), 22) AS priority FROM j GROUP BY doc_id)
    SELECT doc_id, title, array_to_string(names, '; ') AS authors, year, doi, isbn, arxiv, 'synthesized' AS source, priority FROM g WHERE len(names) > 0 OR year <> '' OR doi <> '' OR isbn <> '' OR arxiv <> ''"""


def best_titles(queries: str, catalog: str, threshold: str = _THRESHOLD) -> str:
    """Title search over all pairs: (qid, source, eid, title, score, confidence)."""
    near = "(2.0 * least(length(a), length(b)) >= 0.8 * (length(a) + length(b)) AND levenshtein(a, b) <= 0.2 * (length(a) + length(b)) + 1e-9)"
    return f"""WITH q AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, {d.title('title')} AS a FROM ({queries})), k AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, {d.title('title')} AS b FROM ({catalog})),
    pairs AS MATERIALIZED (SELECT a, b FROM (SELECT DISTINCT a FROM q WHERE a <> ''), (SELECT DISTINCT b FROM k WHERE b <> '') WHERE {near} OR {d.jaccard('a', 'b')} >= 0.8),
    s AS (SELECT q.qid, k.eid, k.source, k.title, {SCORE} AS score, {threshold} AS least FROM {d.similar('SELECT a, b FROM pairs')} JOIN q USING (a) JOIN k USING (b))
    SELECT qid, source, eid, title, round(score, 6) AS score, {BAND} AS confidence FROM s WHERE score >= least - 1e-12 QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, eid) = 1"""


def rest_titles(queries: str, catalog: str) -> str:
    """Title search by words, and over all pairs for the queries that so find nothing: (qid, source, eid, title, score, confidence)."""
    near = "(2.0 * least(length(a), length(b)) >= 0.8 * (length(a) + length(b)) AND levenshtein(a, b) <= 0.2 * (length(a) + length(b)) + 1e-9)"
    tokens = "SELECT {k}, unnest(list_distinct(string_split({x}, ' '))) AS token FROM {t} WHERE {x} <> ''"
    best = f"SELECT qid, source, eid, title, score, {BAND} AS confidence FROM s WHERE score >= least - 1e-12 QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, eid) = 1"
    return f"""WITH q AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, {d.title('title')} AS a FROM ({queries})), k AS MATERIALIZED (SELECT *, {d.surnames('names')} AS sn, {d.title('title')} AS b FROM ({catalog})),
    kt AS MATERIALIZED ({tokens.format(k='eid', x='b', t='k')}), qt AS (SELECT qid, t.token, list_contains({d.lst(STOP_WORDS)}, t.token) AS stop, coalesce(n, 0) AS df FROM ({tokens.format(k='qid', x='a', t='q')}) t LEFT JOIN (SELECT token, count(*) AS n FROM kt GROUP BY 1) USING (token)),
    pick AS (SELECT qid, token FROM (SELECT *, {_rarest('qid')} AS x, {_rarest('qid, stop')} AND NOT stop AS y FROM qt) WHERE (x OR y) AND df > 0),
    near AS MATERIALIZED (SELECT a, b FROM (SELECT DISTINCT a FROM q WHERE a <> ''), (SELECT DISTINCT b FROM k WHERE b <> '') WHERE {near} OR {d.jaccard('a', 'b')} >= 0.8),
    s AS MATERIALIZED (SELECT q.qid, k.eid, k.source, k.title, {SCORE} AS score, {_THRESHOLD} AS least FROM {d.similar('SELECT a, b FROM near')} JOIN q USING (a) JOIN k USING (b)),
    blocked AS (SELECT DISTINCT qid, eid FROM pick JOIN kt USING (token) UNION SELECT qid, eid FROM q JOIN k ON a = b WHERE a <> ''),
    by_word AS MATERIALIZED ({best.replace('FROM s WHERE', 'FROM s SEMI JOIN blocked USING (qid, eid) WHERE')}),
    by_all AS ({best.replace('FROM s WHERE', 'FROM s WHERE qid NOT IN (SELECT qid FROM by_word) AND')})
    SELECT qid, source, eid, title, round(score, 6) AS score, confidence FROM by_word UNION ALL SELECT qid, source, eid, title, round(score, 6), confidence FROM by_all"""
