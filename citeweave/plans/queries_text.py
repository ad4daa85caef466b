"""Queries of text functions, identifier extraction and predicates (B, C, D, E, F1-F4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import identifiers as ids
from citeweave.functions import quality, repair, similarity
from citeweave.functions import text as tx
from citeweave.operators import extract
from citeweave.operators.candidates import identifier_pool
from citeweave.plans import ducksql as d
from citeweave.plans import inputs as src
from citeweave.plans.registered import query

ENGLISH = "SELECT doc_id, text, source FROM {documents}"


def mentions(spark, sf_dir) -> DataFrame:
    return src.load(spark, sf_dir, src.MENTIONS, {"orders": "o_orderkey"})


def _docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _from(sql: str) -> str:
    return f"({src.oracle(sql)}) AS t"


def _sorted(c):
    return F.array_join(F.array_sort(c), "; ")


@query("b1_clean_text", f"SELECT doc_id, sha256({d.clean('text')}) AS cleaned FROM documents")
def b1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.clean_text(F.col("text")), 256).alias("cleaned"))


@query(
    "b2_b3_b8_b11_titles",
    f"SELECT id, {d.title('title')} AS norm, {d.sanity('title')} AS sane, {d.first_year('title')} AS first_year, "
    f"trim(regexp_replace({d.clean('title')}, '\\s*\\([0-9]{{4}}(?:\\s*,[^)]*)?\\)?$', ''), ' -_.,;:') AS bare FROM {_from(src.TITLES)}",
)
def b2(spark, sf_dir):
    t = F.col("title")
    cut = tx.strip_title_metadata(t)["title"]
    return src.load(spark, sf_dir, src.TITLES).select(
        "id", tx.normalize_title(t).alias("norm"), tx.normalize_for_sanity(t).alias("sane"), tx.first_year(t).alias("first_year"), tx.strip(cut, " -_.,;:").alias("bare")
    )


@query("b4_b5_b15_authors", f"SELECT id, {d.author('raw')} AS name, {d.norm_author('raw')} AS norm, {d.surname('raw')} AS surname FROM {_from(src.NAMES)}")
def b4(spark, sf_dir):
    r = F.col("raw")
    return src.load(spark, sf_dir, src.NAMES).select("id", tx.clean_author_name(r).alias("name"), tx.normalize_author(r).alias("norm"), tx.author_surname(r).alias("surname"))


@query("b6_footnote_markers", f"SELECT id, {d.footnotes("concat(raw, '†12 *')")} AS name FROM {_from(src.NAMES)}")
def b6(spark, sf_dir):
    marked = F.concat("raw", F.lit("†12 *"))
    return src.load(spark, sf_dir, src.NAMES).select("id", tx.strip_footnote_markers(marked).alias("name"))


@query("b7_split_authors", f"SELECT id, {d.joined(d.split_authors('raw'), ' | ')} AS names FROM {_from(src.NAMES)}")
def b7(spark, sf_dir):
    return src.load(spark, sf_dir, src.NAMES).select("id", F.array_join(tx.split_authors(F.col("raw")), " | ").alias("names"))


_INITIALS = "array_to_string(list_transform(string_split(lower(title), ' '), lambda w: concat(upper(substr(w, 1, 1)), substr(w, 2))), ' ')"


@query("b9_b10_filename_text", f"SELECT id, {d.decamel("replace(name, ' ', '')")} AS split, {d.file_title('name')} AS cleaned FROM (SELECT id, concat('[Series] NIPS-2019-', {_INITIALS}, id, '_main') AS name FROM {_from(src.TITLES)})")
def b9(spark, sf_dir):
    name = F.concat(F.lit("[Series] NIPS-2019-"), F.initcap("title"), F.col("id").cast("string"), F.lit("_main"))
    return src.load(spark, sf_dir, src.TITLES).select("id", tx.decamelize(F.replace(name, F.lit(" "), F.lit(""))).alias("split"), tx.clean_filename_text(name).alias("cleaned"))


@query(
    "b14_b16_paths",
    f"SELECT doc_id, {d.filename('path')} AS norm, CASE WHEN {d.match('priority', '^[0-9.-]+$')} THEN 'imported' ELSE trim(replace(priority, ',', ' ')) END AS tags "
    f"FROM (SELECT *, string_split(path, '/')[3] AS priority FROM {_from(src.MENTIONS)})",
)
def b14(spark, sf_dir):
    p = F.col("path")
    return mentions(spark, sf_dir).select("doc_id", tx.normalize_filename(p).alias("norm"), F.array_join(tx.path_tags("/lib", p), ", ").alias("tags"))


def _broken(x: str) -> str:
    return d.sub(d.sub(f"coalesce({x}, '')", r"[^\x00-\x7f]"), r"\b([A-Z])([a-z])([a-z]{3,})", r"\1 X\3")


def _repaired() -> str:
    """Whole texts without their accents, words broken; the title rounds one below the other."""
    rounds = "SELECT id, t, y, " + d.halves_joined("t", "{1,}") + " AS u FROM w"
    for _ in range(repair.ROUNDS):
        rounds = f"SELECT id, t, y, {d.fragments_joined('u')} AS u FROM ({rounds})"
    count = lambda p: f"len({d.found0('t', p)})"
    return (
        f"WITH w AS MATERIALIZED (SELECT doc_id AS id, {_broken('text')} AS t, {d.halves_joined(_broken('text'), '{2,}')} AS y FROM documents) SELECT id AS doc_id, sha256(CASE WHEN {count(repair.TEXT_SPLIT)} >= 3 THEN y ELSE t END) AS text, "
        f"sha256(CASE WHEN {count(repair.TITLE_SPLIT)} >= 2 THEN u ELSE t END) AS title FROM ({rounds})"
    )


@query("b12_b13_ligatures", _repaired())
def b12(spark, sf_dir):
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x00-\\x7f]", "")
    df = _docs(spark, sf_dir).select("doc_id", F.regexp_replace(plain, r"\b([A-Z])([a-z])([a-z]{3,})", "$1 X$3").alias("t"))
    return df.select("doc_id", F.sha2(repair.repair_ligatures(F.col("t")), 256).alias("text"), F.sha2(repair.repair_title_ligatures(F.col("t")), 256).alias("title"))


MENTION_SQL = _from(src.MENTIONS)


@query("c1_dois", f"SELECT doc_id, {d.joined(d.unique(d.dois('text')))} AS dois FROM {MENTION_SQL}")
def c1(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", _sorted(ids.extract_dois(F.col("text"))).alias("dois"))


@query(
    "c2_isbns",
    f"SELECT doc_id, {d.joined(d.unique(f'list_transform({d.found('text', r'[^0-9]((?:97[89][-\s]?)?[0-9][0-9\s-]{8,20}[0-9Xx])[^0-9]')}, lambda c: {d.isbn('c')})'))} AS isbns FROM {MENTION_SQL}",
)
def c2(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", _sorted(ids.extract_isbns(F.col("text"))).alias("isbns"))


@query("c3_arxivs", f"SELECT doc_id, {d.joined(d.unique(d.found('text', r'(?i)arXiv: ([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)\b')))} AS arxivs FROM {MENTION_SQL}")
def c3(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", _sorted(ids.extract_arxivs(F.col("text"))).alias("arxivs"))


@query("c4_stable_ids", f"SELECT doc_id, {d.joined(d.unique(d.found('text', r'(?i)\b(stable/[0-9]+)\b')))} AS stable FROM {MENTION_SQL}")
def c4(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", _sorted(ids.extract_stable_ids(F.col("text"))).alias("stable"))


RAW_ISBN = "SELECT l_orderkey AS k, l_linenumber AS n, concat(cast(l_partkey * 7919 % 1000000000 as varchar(20)), '-', cast(l_suppkey % 10 as varchar(9)), CASE WHEN l_linenumber % 3 = 0 THEN 'x' ELSE cast(l_linenumber % 10 as varchar(9)) END) AS ten, concat('978-', lpad(cast(l_orderkey as varchar(20)), 9, '0'), ' ', cast(l_linenumber % 10 as varchar(9))) AS thirteen FROM {lineitem}"


@query("c5_validate_isbn", f"SELECT k, n, {d.isbn('ten')} AS ten, {d.isbn('thirteen')} AS thirteen FROM {_from(RAW_ISBN)}")
def c5(spark, sf_dir):
    rows = src.load(spark, sf_dir, RAW_ISBN)
    return rows.select("k", "n", ids.validate_isbn(F.col("ten")).alias("ten"), ids.validate_isbn(F.col("thirteen")).alias("thirteen"))


PII = (
    "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN concat('S', lpad(cast(o_orderkey as varchar(20)), 8, '0'), '0812345', cast(o_orderkey % 10 as varchar(9))) "
    "WHEN 1 THEN concat('s', '0049-237x(08)', lpad(cast(o_orderkey as varchar(20)), 5, '0'), '-8') WHEN 2 THEN concat(lpad(cast(o_orderkey as varchar(20)), 7, '1'), 'X', '08123456') "
    "ELSE concat('S12', cast(o_orderkey as varchar(20))) END AS pii FROM {orders}"
)
_U = "upper(trim(pii))"


@query(
    "c6_pii_to_doi",
    f"SELECT k, CASE WHEN {d.match(_U, r'^S[0-9]{4}-[0-9]{3}[0-9X]\([0-9]{2}\)[0-9]{5}-[0-9]$')} THEN concat('10.1016/', {_U}) "
    f"WHEN {d.match(_U, '^S[0-9]{4}[0-9X]{4}[0-9]{8}$')} THEN concat('10.1016/S', substr({_U}, 2, 4), '-', substr({_U}, 6, 4), '(', substr({_U}, 10, 2), ')', substr({_U}, 12, 5), '-', substr({_U}, 17, 1)) "
    f"WHEN {d.match(_U, '^[0-9]{4}[0-9X]{4}[0-9]{8}$')} THEN concat('10.1016/', substr({_U}, 1, 4), '-', substr({_U}, 5, 4), '(', substr({_U}, 9, 2), ')', substr({_U}, 11, 5), '-', substr({_U}, 16, 1)) ELSE '' END AS doi FROM {_from(PII)}",
)
def c6(spark, sf_dir):
    return src.load(spark, sf_dir, PII).select("k", ids.pii_to_doi(F.col("pii")).alias("doi"))


_STEM = "regexp_extract(path, '([^/]*)\\.pdf$', 1)"


@query(
    "c7_filename_dois",
    f"SELECT doc_id, CASE WHEN {d.match(_STEM, '^[0-9]{7,10}$')} THEN {d.joined('[' + ', '.join(f'concat({d.text(p)}, {_STEM})' for p in ids.NUMERIC_STEM_PREFIXES) + ']')} ELSE '' END AS guesses FROM {MENTION_SQL}",
)
def c7(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", F.array_join(ids.filename_dois(tx.stem(F.col("path"))), "; ").alias("guesses"))


def with_windows(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("ident_text", F.col("text"))


def candidates(spark, sf_dir) -> DataFrame:
    """Planted candidates with their lists split."""
    split = lambda c: F.filter(F.split(c, "; "), lambda x: x != "")
    return src.load(spark, sf_dir, src.CANDIDATES, {"orders": "o_orderkey"}).withColumns({"authors": split("authors"), "notes": split("notes")})


@query(
    "c8_identifier_pool",
    f"WITH m AS (SELECT * FROM {MENTION_SQL}), found AS (SELECT doc_id, unnest({d.dois('text')}) AS v FROM m), c AS (SELECT doc_id, doi AS v FROM {_from(src.CANDIDATES)} WHERE doi <> ''), "
    f"g AS (SELECT doc_id, unnest([{', '.join(f'concat({d.text(p)}, {_STEM})' for p in ids.NUMERIC_STEM_PREFIXES)}]) AS v FROM m WHERE {d.match(_STEM, '^[0-9]{7,10}$')}), "
    "every AS (SELECT * FROM found UNION SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM m) UNION SELECT * FROM g), "
    f"i AS (SELECT DISTINCT doc_id, unnest(list_transform({d.found('text', r'[^0-9]((?:97[89][-\s]?)?[0-9][0-9\s-]{8,20}[0-9Xx])[^0-9]')}, lambda c: {d.isbn('c')})) AS v FROM m) "
    "SELECT doc_id, 'doi' AS kind, v AS value FROM every UNION ALL SELECT doc_id, 'isbn', v FROM i WHERE v <> '' "
    f"UNION ALL SELECT DISTINCT doc_id, 'arxiv', unnest({d.found('text', r'(?i)arXiv: ([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)\b')}) FROM m "
    f"UNION ALL SELECT DISTINCT doc_id, 'stable', unnest({d.found('text', r'(?i)\b(stable/[0-9]+)\b')}) FROM m",
)
def c8(spark, sf_dir):
    return identifier_pool(with_windows(mentions(spark, sf_dir)), candidates(spark, sf_dir)).select("doc_id", "kind", "value")


_PREDICATES = {
    "garbage": (quality.is_garbage_title, d.garbage), "software": (quality.is_software_title, d.software_title), "software_author": (quality.is_software_author, d.software_author),
    "journal_header": (quality.is_journal_header, d.journal_header), "journal_abbrev": (quality.is_journal_abbrev, d.journal_abbrev), "series": (quality.is_series_banner, d.series),
    "suspicious": (quality.is_suspicious_title, d.suspicious), "noise": (quality.is_noise_line, d.noise), "author_line": (quality.looks_like_authors, d.author_line), "distinctive": (quality.is_distinctive_title, d.distinctive),
}


def _predicate_query(number: str, name: str) -> None:
    spark_side, duck_side = _PREDICATES[name]

    @query(f"{number}_{name}", f"SELECT id, {duck_side('title')} AS holds FROM {_from(src.TITLES)}")
    def one(spark, sf_dir):
        return src.load(spark, sf_dir, src.TITLES).select("id", spark_side(F.col("title")).alias("holds"))


for _n, _k in zip(("d1", "d2", "d3", "d4", "d5", "d6", "d7", "d8", "d13", "d12"), ("garbage", "software", "software_author", "journal_header", "journal_abbrev", "series", "suspicious", "noise", "author_line", "distinctive")):
    _predicate_query(_n, _k)

_N_AUTHORS = "CASE WHEN author = '' THEN 0 ELSE 1 END"


@query("d11_searchable", f"SELECT id, {d.searchable('title', _N_AUTHORS, 'year')} AS searchable FROM {_from(src.TITLES)}")
def d11(spark, sf_dir):
    authors = F.filter(F.array("author"), lambda a: a != "")
    return src.load(spark, sf_dir, src.TITLES).select("id", quality.is_searchable(F.col("title"), authors, F.col("year")).alias("searchable"))


_T = "coalesce(text, '')"


@query("d9_unreadable_text", f"SELECT doc_id, {d.unreadable(_T)} AS unreadable FROM documents")
def d9(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", quality.is_unreadable_text(F.col("text")).alias("unreadable"))


@query("d10_book", f"SELECT doc_id, {d.book('path', 'text')} AS book FROM {MENTION_SQL}")
def d10(spark, sf_dir):
    return mentions(spark, sf_dir).select("doc_id", quality.is_book(F.col("path"), F.col("text")).alias("book"))


_FILES = (
    "SELECT id AS doc_id, replace(CASE id % 5 WHEN 0 THEN concat(title, ' (2019, Press) -- Ann_Reed -- 2019 -- 9780306406157 -- ', md5(cast(id as varchar(20)))) WHEN 1 THEN concat('(Series) Ann Reed_Bo Stone - ', title, ' (2011, Press)') "
    f"WHEN 2 THEN concat('Ann Reed - ', title) WHEN 3 THEN CASE id % 3 WHEN 0 THEN 'Bo Stone - J Math' WHEN 1 THEN concat('[Old] Cy Lee, Di Reed - ', title, ' - libgen.li') ELSE concat(title, ' (1999)-2') END ELSE title END, '/', '_') AS stem FROM ({src.TITLES}) AS t"
)


@query("e1_filename_candidates", d.filename_candidates(f"SELECT doc_id, CASE WHEN stem = '' THEN '.pdf' ELSE stem END AS stem FROM ({src.oracle(_FILES)})"))
def e1(spark, sf_dir):
    names = src.load(spark, sf_dir, _FILES, {"part": "p_partkey"}).select("doc_id", F.concat(F.lit("/lib/"), "stem", F.lit(".pdf")).alias("path"))
    return extract.candidates_from_filename(names).withColumns({c: F.array_join(c, "; ") for c in ("authors", "notes")})


#: Documents behind header lines of several kinds.
HEADERS = (
    "SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN concat('Downloaded from here', chr(10), 'WAVES IN DEEP WOOD OF ', upper(source), chr(10), 'A THEORY OF ALL', chr(10), 'Ann Reed, Bo Stone', chr(10)) "
    "WHEN 1 THEN concat('Journal of Wood', chr(13), chr(10), 'On the  growth of ', source, ' trees', chr(10), 'Ann Reed; Bo Stone†1', chr(10)) WHEN 2 THEN concat('STATE-OF-ART: WOOD', chr(10), 'Author(s): Cy Lee', chr(10)) "
    "WHEN 3 THEN concat('short', chr(10), 'tiny', chr(10)) WHEN 4 THEN concat('Proceedings of 1999 in doc', chr(10), 'W A V E S', chr(10), 'Trees of ', source, ' in 2001', chr(10), 'by the editors:', chr(10)) ELSE '' END, coalesce(text, '')) AS text FROM {documents}"
)


def _headed() -> str:
    title = f"CASE WHEN k = 0 THEN substr(coalesce(lines[1], ''), 1, 220) WHEN sub THEN concat(rtrim({d.title_case('lines[k]')}, ':'), ': ', {d.title_case('nxt')}) WHEN caps THEN {d.title_case('lines[k]')} ELSE lines[k] END"
    title = title.replace(f"rtrim({d.title_case('lines[k]')}, ':')", f"rtrim(CASE WHEN caps THEN {d.title_case('lines[k]')} ELSE lines[k] END, ':')")
    names = f"CASE WHEN k = 0 THEN coalesce(lines[2], '') WHEN {d.author_line('third')} AND (caps OR length(third) < 120) THEN third ELSE '' END"
    split = f"list_filter(list_transform({d.split_authors('names')}, lambda a: {d.footnotes('a')}), lambda a: a <> '')"
    fits = f"list_transform(lines[1:{extract.TITLE_LINES}], lambda l: {d.line_fits('l')})"
    return (
        f"WITH a AS MATERIALIZED (SELECT doc_id, {d.kept_lines('text')} AS lines FROM {_from(HEADERS)}), b AS MATERIALIZED (SELECT *, coalesce(list_position({fits}, true), 0) AS k FROM a WHERE len(lines) > 0), "
        f"c AS (SELECT *, coalesce(lines[k + 1], '') AS nxt, k > 0 AND {d.match('coalesce(lines[k], chr(0))', extract.CAPITALS.replace(chr(92) + 'z', '$'))} AS caps FROM b), "
        f"e AS (SELECT *, {d.capitals('nxt')} AS sub FROM c), f AS (SELECT *, CASE WHEN sub THEN coalesce(lines[k + 2], '') ELSE nxt END AS third FROM e), g AS MATERIALIZED (SELECT *, {title} AS title, {names} AS names FROM f) "
        f"SELECT doc_id, CASE WHEN {d.journal_header('title')} THEN '' ELSE title END AS title, array_to_string({split}, '; ') AS authors, {d.first_year(f"array_to_string(lines[1:{extract.TITLE_LINES}], ' ')")} AS year, 'text_header' AS source, 90 AS priority FROM g"
    )


@query("e2_header_candidates", _headed())
def e2(spark, sf_dir):
    out = extract.candidates_from_header(src.load(spark, sf_dir, HEADERS))
    return out.select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "year", "source", "priority")


PAIRS = (
    "SELECT p_partkey AS id, concat('The ', p_name, ' of ', lower(p_type), ' systems') AS a, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' systems of ', p_type) "
    "WHEN 1 THEN concat('THE ', p_name, '  of ', lower(p_type), ' Systems!') ELSE p_brand END AS b FROM {part}"
)


@query("f1_jaccard_part", f"SELECT id, round({d.jaccard(d.title('a'), d.title('b'))}, 6) AS jaccard FROM {_from(PAIRS)}")
def f1_jaccard(spark, sf_dir):
    pair = tx.normalize_title(F.col("a")), tx.normalize_title(F.col("b"))
    return src.load(spark, sf_dir, PAIRS).select("id", F.round(similarity.word_jaccard(*pair), 6).alias("jaccard"))


@query(
    "f1_f3_f4_title_similarity",
    f"SELECT id, round(sim, 6) AS similarity, round(score, 6) AS score, CASE WHEN score >= 0.97 THEN 'high' WHEN score >= 0.9 THEN 'medium' ELSE 'low' END AS band FROM (SELECT id, sim, sim + 0.05 + CASE WHEN id % 2 = 0 THEN 0.05 ELSE 0 END AS score FROM {_from(PAIRS)} JOIN {d.similar('SELECT a, b FROM ' + _from(PAIRS))} USING (a, b))",
)
def f1(spark, sf_dir):
    s = src.load(spark, sf_dir, PAIRS).withColumn("similarity", similarity.title_similarity(F.col("a"), F.col("b")))
    one = F.array(F.lit("Ann Reed"))
    s = s.withColumn("score", similarity.match_score(F.col("similarity"), one, one, F.lit("2020"), F.when(F.col("id") % 2 == 0, "2020").otherwise("")))
    return s.select("id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), similarity.confidence_band(F.col("score")).alias("band"))


@query("f2_author_overlap", f"SELECT id, round({d.overlap(d.split_names('left_names'), d.split_names('right_names'))}, 6) AS overlap FROM {_from(src.NAMES)}")
def f2(spark, sf_dir):
    return src.load(spark, sf_dir, src.NAMES).select("id", F.round(similarity.author_overlap(F.split("left_names", "; "), F.split("right_names", "; ")), 6).alias("overlap"))


@query("f4_confidence_band", "SELECT event_id, CASE WHEN value / 100 >= 0.97 THEN 'high' WHEN value / 100 >= 0.9 THEN 'medium' ELSE 'low' END AS band FROM events")
def f4(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", similarity.confidence_band(F.col("value") / 100).alias("band"))
