"""Inputs of the registered queries, projected from the driver's tables.

Each is one SQL text that Spark and DuckDB both run, so that a query and its counterpart start from the same rows. Table names
stand in braces. Lists are '; '-joined text and are split where they are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Letters for the digits of a key: surnames and title words that differ from key to key.
LETTERS = "translate(cast({} as varchar(20)), '0123456789', 'abcdefghij')"
FILLER = "the proof of this theorem is in the set of all functions that we define for a space and it is also used as an example where one can let two "


def letters(key: str) -> str:
    return LETTERS.format(key)


def isbn13(key: str) -> str:
    """A valid ISBN-13 of a key."""
    digits = f"concat('978', lpad(cast({key} as varchar(20)), 9, '0'))"
    total = " + ".join(f"{1 if i % 2 else 3} * cast(substr({digits}, {i}, 1) as int)" for i in range(1, 13))
    return f"concat({digits}, cast((10 - ({total}) % 10) % 10 as varchar(2)))"


def doi(key: str) -> str:
    return f"concat('10.1000/ord.', cast({key} as varchar(20)))"


def arxiv(key: str) -> str:
    """An arXiv id of a key: its last five digits, and a month counted from January 2020 by the others."""
    month = f"cast(floor({key} / 100000) as bigint)"
    year = f"cast((20 + cast(floor({month} / 12) as bigint)) % 100 as varchar(20))"
    return f"concat(lpad({year}, 2, '0'), lpad(cast(1 + {month} % 12 as varchar(20)), 2, '0'), '.', lpad(cast({key} % 100000 as varchar(20)), 5, '0'))"


NAMES = f"""
SELECT c_custkey AS id, CASE c_custkey % 8
  WHEN 0 THEN concat('  Ada  Smith', {letters("c_custkey")}, ' (ed.) [eds.]')
  WHEN 1 THEN concat('Author(s): Bo Stone', {letters("c_custkey")}, '; Cy Reed', {letters("c_nationkey")}, ' (editor)')
  WHEN 2 THEN concat('Di Stone', {letters("c_custkey")}, ' and Ed Reed', {letters("c_nationkey")})
  WHEN 3 THEN concat('Stone', {letters("c_custkey")}, ', Flo, Reed', {letters("c_nationkey")}, ', Gus')
  WHEN 4 THEN concat('Stone', {letters("c_custkey")}, ', Hal')
  WHEN 5 THEN concat('Ivo Stone', {letters("c_custkey")}, ' · Jan Reed', {letters("c_nationkey")})
  WHEN 6 THEN concat('Kim_Stone', {letters("c_custkey")}, ' 3')
  ELSE '  ' END AS raw,
  concat('Ada Smith', {letters("c_custkey")}, '; Reed', {letters("c_nationkey")}, ', Bo; Li X') AS left_names,
  concat('A. Smith', {letters("c_custkey % 1000")}, '; Bo Reed', {letters("c_nationkey")}) AS right_names
FROM {{customer}}"""

TITLES = """
SELECT p_partkey AS id, CASE p_partkey % 14
  WHEN 0 THEN concat('The ', p_name, ' of ', lower(p_type), ' systems')
  WHEN 1 THEN concat('Journal of ', p_name)
  WHEN 2 THEN concat('Annals of ', p_name, ' and many more words here ', cast(1990 + p_size as varchar(9)))
  WHEN 3 THEN concat(upper(p_name), ' & ', lower(p_type), ' Vol. 2 Edition')
  WHEN 4 THEN concat('https://example.org/', p_name)
  WHEN 5 THEN concat(p_name, '.pdf')
  WHEN 6 THEN concat('Lecture Notes in ', p_name)
  WHEN 7 THEN concat('J Appl ', p_name)
  WHEN 8 THEN concat('We study ', p_name, ' at the university of ', p_type)
  WHEN 9 THEN concat(p_name, ' (', cast(1950 + p_size as varchar(9)), ', Chapman Press)')
  WHEN 10 THEN concat('  On ', p_name, '    in ', p_type, ' ')
  WHEN 11 THEN CASE p_size % 4 WHEN 0 THEN 'Thesis' WHEN 1 THEN 'Lecture Notes' WHEN 2 THEN 'ABC' ELSE '' END
  WHEN 12 THEN concat('Smith ', upper(substr(p_name, 1, 1)), '. ', cast(1900 + p_size as varchar(9)), ' - ', cast(1950 + p_size as varchar(9)))
  ELSE concat('March ', cast(1 + p_size % 28 as varchar(9)), ', ', cast(1950 + p_size as varchar(9))) END AS title,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE cast(1950 + p_size as varchar(9)) END AS year,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE concat('Ann ', p_brand) END AS author
FROM {part}"""

MENTIONS = f"""
SELECT o.o_orderkey AS doc_id,
  concat('/lib/', lower(o.o_orderpriority), '/2020/', CASE WHEN o.o_orderkey % 5 = 0 THEN cast(1000000 + o.o_orderkey as varchar(20)) ELSE concat('Stone', {letters("o.o_custkey")}, ' - Notes ', {letters("o.o_orderkey")}) END, '.pdf') AS path,
  concat('On order', {letters("o.o_orderkey")}, ' of widgets by Jo Stone', {letters("o.o_custkey")}, '. {FILLER}{FILLER}',
    CASE WHEN o.o_orderkey % 3 = 0 THEN concat('See doi:', upper({doi("o.o_orderkey")}), '. ') ELSE '' END,
    CASE WHEN o.o_orderkey % 7 = 0 THEN concat('Also ', {doi("o.o_orderkey + 1")}, ', and stable/', cast(o.o_orderkey as varchar(20)), ' here. ') ELSE '' END,
    CASE WHEN o.o_orderkey % 4 = 0 THEN concat('ISBN ', {isbn13("p.p_partkey")}, ' of ', p.p_name, ' ', lower(p.p_type), ' ', {letters("p.p_partkey")}, '. ') ELSE '' END,
    CASE WHEN o.o_orderkey % 11 = 0 THEN 'ISBN 9781234567890 is wrong. ' ELSE '' END,
    CASE WHEN o.o_orderkey % 6 = 1 THEN concat('preprint arXiv: ', {arxiv("o.o_orderkey")}, ' end. ') ELSE '' END) AS text
FROM {{orders}} o CROSS JOIN (SELECT min(p_partkey) AS least, count(*) AS n FROM {{part}}) c JOIN {{part}} p ON p.p_partkey = c.least + o.o_orderkey % c.n"""

CATALOG = f"""
SELECT 'crossref_doi' AS source, concat('On order', {letters("o.o_orderkey")}, ' of widgets') AS title, concat('Jo Stone', {letters("o.o_custkey")}) AS authors,
  cast(extract(year FROM o.o_orderdate) as varchar(9)) AS year, {doi("o.o_orderkey")} AS doi, '' AS isbn, '' AS arxiv, 'Press' AS publisher
FROM {{orders}} o WHERE o.o_orderkey % 9 <> 3
UNION ALL
SELECT 'openlibrary_isbn', concat(p_name, ' ', lower(p_type), ' ', {letters("p_partkey")}), concat('Al Baker', {letters("p_partkey")}), '', '', {isbn13("p_partkey")}, '', p_brand
FROM {{part}}
UNION ALL
SELECT 'arxiv_id', concat('Preprint ', {letters("o_orderkey")}), 'Xu Li', '2020', '', '', {arxiv("o_orderkey")}, ''
FROM {{orders}} WHERE o_orderkey % 6 = 1"""

CANDIDATES = f"""
SELECT o_orderkey AS doc_id, 0 AS pos, concat('On order', {letters("o_orderkey")}, ' of widgets') AS title, concat('Jo Stone', {letters("o_custkey")}) AS authors, '' AS year,
  '' AS doi, '' AS isbn, '' AS arxiv, 'pdfinfo' AS source, 15 AS priority, '' AS notes
FROM {{orders}} WHERE o_orderkey % 4 <> 3
UNION ALL
SELECT o_orderkey, 1, CASE o_orderkey % 5 WHEN 0 THEN 'Untitled' WHEN 1 THEN concat('On order', {letters("o_orderkey")}, ' of widgets and bolts') ELSE concat('On order', {letters("o_orderkey")}, ' of widgets') END,
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('Jo Stone', {letters("o_custkey")}, '; Al Baker (ed.)') END, cast(extract(year FROM o_orderdate) as varchar(9)),
  CASE WHEN o_orderkey % 8 = 0 THEN {doi("o_orderkey")} ELSE '' END, '', '', 'grobid', 12, 'header'
FROM {{orders}} WHERE o_orderkey % 6 <> 5
UNION ALL
SELECT o_orderkey, 2, concat('Notes ', {letters("o_orderkey")}), '', '', '', '', '', 'filename_title_only', 80, ''
FROM {{orders}} WHERE o_orderkey % 10 <> 9
UNION ALL
SELECT o_orderkey, 3, concat('On order', {letters("o_orderkey")}, ' of widgets'), concat('Stone', {letters("o_custkey")}, ', Jo'), cast(extract(year FROM o_orderdate) as varchar(9)), '', '', '', 'llm:m', 30, 'model'
FROM {{orders}} WHERE o_orderkey % 2 = 0
UNION ALL
SELECT o_orderkey, 4, concat('On order', {letters("o_orderkey")}, ' of widgets'), concat('Jo Stone', {letters("o_custkey")}), '', '', '', '', 'pdfinfo', 15, ''
FROM {{orders}} WHERE o_orderkey % 20 = 0"""

#: Documents, some without any text, and their candidates by the stage in which they arrive.
STAGED_DOCS = f"SELECT doc_id, path, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text FROM ({MENTIONS}) AS t"
_ORDER_TITLE, _ORDER_AUTHOR, _ORDER_YEAR = f"concat('On order', {letters('o_orderkey')}, ' of widgets')", f"concat('Jo Stone', {letters('o_custkey')})", "cast(extract(year FROM o_orderdate) as varchar(9))"
STAGED = f"""
SELECT o_orderkey AS doc_id, 1 AS stage, 100000 AS pos, {_ORDER_TITLE} AS title, {_ORDER_AUTHOR} AS authors, '' AS year, '' AS doi, '' AS isbn, '' AS arxiv, 'pdfinfo' AS source, 15 AS priority, '' AS notes
FROM {{orders}} WHERE o_orderkey % 4 = 0
UNION ALL
SELECT o_orderkey, 1, 103000, concat('Notes ', {letters("o_orderkey")}), '', '', '', '', '', 'filename_title_only', 80, ''
FROM {{orders}} WHERE o_orderkey % 10 <> 9
UNION ALL
SELECT o_orderkey, 1, 103001, concat({_ORDER_TITLE}, ' and bolts of many kinds'), {_ORDER_AUTHOR}, '', '', '', '', 'filename_structured', 40, 'parsed'
FROM {{orders}} WHERE o_orderkey % 4 = 1
UNION ALL
SELECT o_orderkey, 1, 104000, {_ORDER_TITLE}, {_ORDER_AUTHOR}, '', CASE WHEN o_orderkey % 3 = 0 THEN {doi("o_orderkey")} ELSE '' END, '', '', 'text_header', 90, ''
FROM {{orders}} WHERE o_orderkey % 8 = 2
UNION ALL
SELECT o_orderkey, 2, 205000, CASE o_orderkey % 5 WHEN 0 THEN 'Untitled' WHEN 1 THEN concat({_ORDER_TITLE}, ' and bolts') ELSE {_ORDER_TITLE} END,
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat({_ORDER_AUTHOR}, '; Al Baker (ed.)') END, {_ORDER_YEAR}, CASE WHEN o_orderkey % 8 IN (3, 5) THEN {doi("o_orderkey")} WHEN o_orderkey % 8 = 6 THEN {doi("o_orderkey + 2")} ELSE '' END, '', '', 'grobid', 12, 'header'
FROM {{orders}} WHERE o_orderkey % 6 <> 5
UNION ALL
SELECT o_orderkey, 2, 206000, {_ORDER_TITLE}, concat('Stone', {letters("o_custkey")}, ', Jo'), {_ORDER_YEAR}, '', '', '', 'llm:m', 30, 'model'
FROM {{orders}} WHERE o_orderkey % 7 = 3
UNION ALL
SELECT o_orderkey, 3, 307000, {_ORDER_TITLE}, CASE WHEN o_orderkey % 13 = 0 THEN concat({_ORDER_AUTHOR}, '; {FILLER}{FILLER}') ELSE {_ORDER_AUTHOR} END, '', CASE WHEN o_orderkey % 9 IN (1, 2, 4) THEN {doi("o_orderkey")} ELSE '' END, '', '', 'vision_llm:v', 25, 'seen'
FROM {{orders}} WHERE o_orderkey % 3 <> 0
UNION ALL
SELECT o_orderkey, 4, 408000, {_ORDER_TITLE}, {_ORDER_AUTHOR}, '', '', '', '', 'vision_llm:v', 25, 'seen on more pages'
FROM {{orders}} WHERE o_orderkey % 2 = 1"""

#: A run's result table, its debug rows and another run.
RESULTS = f"""
SELECT o_orderkey AS seq, concat('/lib/', lower(o_orderpriority), '/f', cast(o_orderkey as varchar(20)), '.pdf') AS "File Path",
  CASE o_orderstatus WHEN 'O' THEN 'crossref_doi' WHEN 'F' THEN 'synthesized' ELSE 'openalex_search' END AS "Source",
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS "Confidence", CASE WHEN o_orderkey % 4 < 2 THEN 'yes' ELSE 'no' END AS "Verified",
  concat('On order', {letters("o_orderkey")}, ' of widgets') AS "Title", CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('Jo Stone', {letters("o_custkey")}, '; Al Baker') END AS "Authors",
  cast(extract(year FROM o_orderdate) as varchar(9)) AS "Year", CASE WHEN o_orderkey % 2 = 0 THEN {doi("o_orderkey")} ELSE '' END AS "DOI", '' AS "ISBN", '' AS "arXiv",
  CASE WHEN o_orderkey % 7 = 0 THEN 'no' ELSE 'yes' END AS "Sanity Passed", concat('0.', lpad(cast(o_orderkey % 1000 as varchar(9)), 3, '0')) AS "Sanity Score",
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 'yes' ELSE 'no' END AS "Auto Safe", CASE WHEN o_orderkey % 13 = 0 THEN 'yes' ELSE 'no' END AS "Needs OCR",
  CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' ELSE '' END AS "Error", '' AS "Final Source", CASE WHEN o_orderkey % 3 = 1 THEN 'yes' ELSE 'no' END AS "Soft Auto",
  CASE WHEN o_orderkey % 3 = 1 THEN concat('title corroborated by ', cast(2 + o_orderkey % 3 as varchar(9)), ' strong sources (grobid, pdfinfo)') ELSE '' END AS "Soft Auto Reasons"
FROM {{orders}}"""

DEBUG = """
SELECT o_orderkey AS seq, concat('/lib/', lower(o_orderpriority), '/f', cast(o_orderkey - o_orderkey % 2 as varchar(20)), '.pdf') AS "File Path",
  CASE WHEN o_orderkey % 3 = 0 THEN 'grobid' ELSE 'pdfinfo' END AS "Final Source", 'Debug Author' AS "Authors",
  concat('grobid | pdfinfo ', cast(o_orderkey % 10 as varchar(9))) AS "Candidate Sources"
FROM {orders}"""

PROFILE = """
SELECT concat('/lib/', cast(user_id as varchar(20)), '/f', cast(event_id as varchar(20)), '.pdf') AS "File Path",
  CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skipped: already done' ELSE 'processed' END AS "Status",
  CASE WHEN event_type = 'error' THEN concat('HTTP ', cast(400 + user_id % 5 as varchar(9))) ELSE '' END AS "Error",
  CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END AS "Final Source", CASE user_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE '' END AS "Confidence",
  CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS "Verified", cast(value as varchar(30)) AS "File Wall s", CASE WHEN user_id % 6 = 0 THEN 'n/a' ELSE cast(value / 2 as varchar(30)) END AS "Resolve Total s",
  cast(value / 4 as varchar(30)) AS "Crossref Search s", cast(user_id % 7 as varchar(9)) AS "Crossref Search Candidates Tried", cast(user_id % 3 as varchar(9)) AS "Crossref Search Matches", '0' AS "Crossref Search Errors",
  '0.5' AS "OpenAlex Search s", '0' AS "OpenAlex Search Candidates Tried", '0' AS "OpenAlex Search Matches", cast(user_id % 2 as varchar(9)) AS "OpenAlex Search Errors",
  '' AS "Semantic Scholar Search s", '' AS "Semantic Scholar Search Candidates Tried", '' AS "Semantic Scholar Search Matches", '' AS "Semantic Scholar Search Errors",
  '0.25' AS "OpenLibrary Search s", '2' AS "OpenLibrary Search Candidates Tried", '1' AS "OpenLibrary Search Matches", '0' AS "OpenLibrary Search Errors",
  '0' AS "Google Books Search s", '1.0' AS "Google Books Search Candidates Tried", '1' AS "Google Books Search Matches", '0' AS "Google Books Search Errors",
  CASE WHEN user_id % 9 = 0 THEN 'broken' ELSE concat('[', chr(123), '"kind":"doi","resolver":"', event_type, '","matched":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"error":"', CASE WHEN user_id % 5 = 0 THEN 'timeout' ELSE '' END, '"', chr(125), ']') END AS "Identifier Lookups JSON",
  concat('[', chr(123), '"source":"crossref","error_messages":["e', cast(user_id % 3 as varchar(9)), '"," "],"skip_reason":"', CASE WHEN user_id % 2 = 0 THEN 'disabled' ELSE '' END, '"', chr(125), ']') AS "Title Searches JSON"
FROM {events}"""


#: Titles to search, spelt well and less well, and the catalog that they are searched in.
_WORK = f"concat('On', {letters("(p_partkey * 7919) % 1000003")}, ' ', p_name, ' ', {letters("(p_partkey * 104729) % 999983")}, ' of ', {letters("(p_partkey * 1299709) % 999979")}, ' ', lower(p_type))"
TITLE_QUERIES = f"""
SELECT id AS qid, id AS doc_id, 1 AS nth, CASE id % 7 WHEN 0 THEN t WHEN 1 THEN concat(substr(t, 1, 13), substr(t, 15)) WHEN 2 THEN concat(substr(t, 1, 4), 'x', substr(t, 6, 14), 'zq', substr(t, 22))
  WHEN 3 THEN concat(upper(t), '!') WHEN 4 THEN substr(t, 10) WHEN 5 THEN concat(t, ' revised') ELSE concat('Some ', substr(t, 1, 20), substr(t, 23)) END AS title,
  CASE id % 3 WHEN 0 THEN concat('Ann Reed', {letters("id % 97")}) WHEN 1 THEN 'Bo Stone' ELSE '' END AS authors, CASE WHEN id % 2 = 0 THEN y ELSE '' END AS year
FROM (SELECT p_partkey AS id, {_WORK} AS t, cast(1950 + p_size as varchar(9)) AS y FROM {{part}}) AS w"""
TITLE_CATALOG = f"""
SELECT p_partkey AS eid, CASE p_partkey % 5 WHEN 0 THEN 'crossref_search' WHEN 1 THEN 'openalex_search' WHEN 2 THEN 'google_books_search' WHEN 3 THEN 'openlibrary_search' ELSE 'semanticscholar_search' END AS source,
  {_WORK} AS title, concat('Reed', {letters("p_partkey % 97")}, ', A.; Cy Lee') AS authors, cast(1950 + p_size as varchar(9)) AS year, '' AS doi, '' AS isbn, '' AS arxiv, p_brand AS publisher
FROM {{part}}"""


def to_all_tasks(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key, before text is made of them, be their files few."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def load(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """The rows of an input. ``dealt`` names tables, with a key, that go to all tasks before text is made of them, be their files few."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))}
    tables |= {t: to_all_tasks(tables[t], key) for t, key in (dealt or {}).items()}
    text = sql.replace('"', "`") if sql in (RESULTS, DEBUG) else _quoted(sql)
    return spark.sql(text, **tables)


def _quoted(sql: str) -> str:
    """Spark's quotes for column aliases; double quotes inside string literals stay."""
    return re.sub(r'AS "([^"]+)"', r"AS `\1`", sql)


def oracle(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)
