"""Stored service replies → catalog entries and candidates. Every function takes rows with a JSON or XML text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.identifiers import extract_arxivs, extract_dois, extract_isbns, validate_isbn
from citeweave.functions.quality import is_software_author, is_software_title, is_suspicious_title
from citeweave.functions.text import clean_text, first_year, given, split_authors, strip_footnote_markers

_DATE = "struct<`date-parts`:array<array<int>>>"
_WORK = (
    "struct<title:array<string>,author:array<struct<given:string,family:string>>,DOI:string,publisher:string,"
    f"`published-print`:{_DATE},`published-online`:{_DATE},issued:{_DATE},created:{_DATE}>"
)
_NONE = "cast(array() as array<string>)"


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first(c: Column) -> Column:
    return _blank(F.get(c, F.lit(0)))


def _list(c: Column) -> Column:
    """Cleaned non-blank strings of an array, in order."""
    return F.coalesce(F.filter(F.transform(c, clean_text), lambda a: a != ""), F.expr(_NONE))


def _entry(df: DataFrame, source: str, title: Column, authors: Column, year: Column, doi=None, isbn=None, arxiv=None, publisher=None, titled: bool = True) -> DataFrame:
    text = lambda c: F.lit("") if c is None else clean_text(c)
    out = df.select(
        F.lit(source).alias("source"), clean_text(title).alias("title"), authors.alias("authors"), _blank(year).alias("year"), text(doi).alias("doi"),
        (F.lit("") if isbn is None else _blank(isbn)).alias("isbn"), text(arxiv).alias("arxiv"), text(publisher).alias("publisher"),
    )
    return out.filter(F.col("title") != "") if titled else out


def _work_entry(df: DataFrame, w: str, source: str) -> DataFrame:
    name = F.transform(F.col(f"{w}.author"), lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit(""))))
    dates = [F.get(F.get(F.col(f"{w}.`{k}`.`date-parts`"), F.lit(0)), F.lit(0)).cast("string") for k in ("published-print", "published-online", "issued", "created")]
    return _entry(df, source, _first(F.col(f"{w}.title")), _list(name), F.coalesce(*dates), doi=F.col(f"{w}.DOI"), publisher=F.col(f"{w}.publisher"))


def catalog_from_crossref(df: DataFrame, payload: str = "payload", search: bool = False) -> DataFrame:
    """A works message, or with ``search`` its list of items. Rows without a title go."""
    if search:
        items = df.select(F.explode(F.from_json(payload, f"message struct<items:array<{_WORK}>>")["message"]["items"]).alias("w"))
        return _work_entry(items, "w", "crossref_search")
    return _work_entry(df.select(F.from_json(payload, f"message {_WORK}")["message"].alias("w")), "w", "crossref_doi")


def catalog_from_openlibrary_books(df: DataFrame, payload: str = "payload") -> DataFrame:
    shape = "map<string,struct<title:string,authors:array<struct<name:string>>,publish_date:string,publishers:array<struct<name:string>>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)).alias("k", "b")).filter(F.col("k").startswith("ISBN:"))
    rows = rows.withColumn("isbn", validate_isbn(F.expr("substring(k, 6)"))).filter("isbn <> ''")
    names = F.filter(F.col("b.authors.name"), lambda n: _blank(n) != "")
    authors = F.coalesce(F.transform(names, clean_text), F.expr(_NONE))
    return _entry(rows, "openlibrary_isbn", F.col("b.title"), authors, first_year(F.col("b.publish_date")), isbn=F.col("isbn"), publisher=_first(F.col("b.publishers.name")), titled=False)


def _first_valid(isbns: Column) -> Column:
    return _blank(F.get(F.filter(F.transform(isbns, validate_isbn), lambda x: x != ""), F.lit(0)))


def catalog_from_openlibrary_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    shape = "docs array<struct<title:string,author_name:array<string>,first_publish_year:string,isbn:array<string>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["docs"]).alias("d"))
    authors = F.coalesce(F.transform(F.col("d.author_name"), clean_text), F.expr(_NONE))
    return _entry(rows, "openlibrary_search", F.col("d.title"), authors, F.col("d.first_publish_year"), isbn=_first_valid(F.col("d.isbn")))


def catalog_from_semanticscholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    shape = "data array<struct<title:string,authors:array<struct<name:string>>,year:int,externalIds:struct<DOI:string,ArXiv:string>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["data"]).alias("d"))
    authors = F.coalesce(F.transform(F.col("d.authors.name"), clean_text), F.expr(_NONE))
    year = F.nullif(F.col("d.year"), F.lit(0)).cast("string")
    return _entry(rows, "semanticscholar_search", F.col("d.title"), authors, year, doi=F.col("d.externalIds.DOI"), arxiv=F.col("d.externalIds.ArXiv"))


def catalog_from_openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    shape = (
        "results array<struct<display_name:string,title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,"
        "doi:string,ids:struct<doi:string>,primary_location:struct<source:struct<display_name:string>>>>"
    )
    rows = df.select(F.explode(F.from_json(payload, shape)["results"]).alias("r"))
    title = F.coalesce(F.nullif(F.col("r.display_name"), F.lit("")), F.col("r.title"))
    doi = F.regexp_replace(F.coalesce(F.nullif(F.col("r.doi"), F.lit("")), F.col("r.ids.doi"), F.lit("")), "https?://doi\\.org/", "")
    year = F.nullif(F.col("r.publication_year"), F.lit(0)).cast("string")
    return _entry(rows, "openalex_search", title, _list(F.col("r.authorships.author.display_name")), year, doi=doi, publisher=F.col("r.primary_location.source.display_name"))


def catalog_from_google_books(df: DataFrame, payload: str = "payload") -> DataFrame:
    shape = "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publishedDate:string,publisher:string,industryIdentifiers:array<struct<identifier:string>>>>>"
    rows = df.select(F.explode(F.from_json(payload, shape)["items"]["volumeInfo"]).alias("v"))
    isbn = _first_valid(F.col("v.industryIdentifiers.identifier"))
    return _entry(rows, "google_books_search", F.col("v.title"), _list(F.col("v.authors")), first_year(F.col("v.publishedDate")), isbn=isbn, publisher=F.col("v.publisher"))


def _all_text(xml: Column) -> Column:
    """Text of all elements, markup removed."""
    plain = F.regexp_replace(xml, "<[^>]*>", " ")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return clean_text(plain)


def catalog_from_arxiv_atom(df: DataFrame, payload: str = "payload", arxiv: str = "arxiv") -> DataFrame:
    """First Atom entry of each feed; ``arxiv`` is the id that was asked for."""
    entry = F.regexp_extract(payload, r"(?s)<entry[\s>].*?</entry>", 0)
    rows = df.select(F.col(arxiv).alias("a"), F.col(payload).alias("x"), entry.alias("e")).filter("e <> ''")
    one = lambda p: _first(F.xpath("x", F.lit(f"/feed/entry[1]/{p}/text()")))
    blob = _all_text(F.col("e"))
    return _entry(
        rows, "arxiv_id", one("title"), _list(F.xpath("x", F.lit("/feed/entry[1]/author/name/text()"))), first_year(one("published")),
        doi=_first(extract_dois(blob)), isbn=_first(extract_isbns(blob)), arxiv=F.col("a"), titled=False,
    )


def _candidate(title: Column, authors: Column, year: Column, doi: Column, isbn: Column, arxiv: Column, source: Column, priority: int, notes: Column | None = None) -> list[Column]:
    pairs = dict(title=title, authors=authors, year=year, doi=doi, isbn=isbn, arxiv=arxiv, source=source, priority=F.lit(priority), notes=F.expr(_NONE) if notes is None else notes)
    return [c.alias(k) for k, c in pairs.items()]


def candidates_from_tei(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Header TEI → ``grobid`` candidate; a suspicious title is blanked, a row with nothing left goes."""
    # each path reads the whole reply, so it is looked up once a row, and no later step is pulled in front of that
    title = given(clean_text(_first(F.xpath(payload, F.lit("//titleStmt/title[1]/text()")))), lambda t: F.when(is_suspicious_title(t), "").otherwise(t))
    # an author without one of the two names has an empty place in its list
    count = F.xpath_int(payload, F.lit("count(//sourceDesc//author)"))
    fore, sur = (F.xpath(payload, F.lit(f"//sourceDesc//author//{k}[1]/text()")) for k in ("forename", "surname"))
    paired = F.zip_with(fore, sur, lambda a, b: F.concat_ws(" ", a, b))
    read = F.struct(title.alias("title"), _list(F.when(count == 0, F.expr(_NONE)).otherwise(paired)).alias("authors"), _all_text(F.col(payload)).alias("blob"))
    rows = df.select("doc_id", F.inline(F.array(read)))
    blob = F.col("blob")
    out = rows.select("doc_id", *_candidate(F.col("title"), F.col("authors"), first_year(blob), _first(extract_dois(blob)), _first(extract_isbns(blob)), _first(extract_arxivs(blob)), F.lit("grobid"), 12))
    return out.filter((F.col("title") != "") | (F.size("authors") > 0) | (F.col("doi") != "") | (F.col("isbn") != "") | (F.col("arxiv") != ""))


def reply_content(payload: Column) -> Column:
    """The message text of a chat completion of either shape."""
    return F.coalesce(F.get_json_object(payload, "$.choices[0].message.content"), F.get_json_object(payload, "$.message.content"))


def _joined(field: Column) -> Column:
    """A field that may be a string or a list of strings, the list joined by blanks."""
    listed = F.array_join(F.filter(F.from_json(field, "array<string>"), lambda x: _blank(x) != ""), " ")
    return clean_text(F.when(field.startswith("["), listed).otherwise(field))


def candidates_from_llm_json(df: DataFrame, kind: str = "llm", payload: str = "payload", model: str = "model") -> DataFrame:
    """Chat replies → candidates: ``llm:<model>`` (priority 30, needs title or authors) or ``vision_llm:<model>`` (25, identifiers suffice)."""
    rows = df.withColumn("__c", reply_content(F.col(payload)))
    of = lambda k: F.get_json_object("__c", f"$.{k}")
    authors = _list(F.from_json(of("authors"), "array<string>"))
    note = _joined(of("notes"))
    notes = F.when(note == "", F.expr(_NONE)).otherwise(F.array(note))
    source = F.concat(F.lit(f"{kind}:"), F.col(model))
    extra = ["pages"] if kind == "vision_llm" and "pages" in df.columns else []
    if extra:
        notes = F.concat(F.array(F.concat(F.lit("vision-extracted from "), F.col("pages").cast("string"), F.lit(" page(s)"))), notes)
    out = rows.select("doc_id", *_candidate(_joined(of("title")), authors, _joined(of("year")), _joined(of("doi")), validate_isbn(_joined(of("isbn"))), _joined(of("arxiv")), source, 25 if kind == "vision_llm" else 30, notes))
    enough = (F.col("title") != "") | (F.size("authors") > 0)
    if kind == "vision_llm":
        enough = enough | (F.col("doi") != "") | (F.col("isbn") != "") | (F.col("arxiv") != "")
    return out.filter(enough)


def llm_response_usable(df: DataFrame, payload: str = "payload", local: bool = False) -> DataFrame:
    """Replies worth keeping. Remote: no error, content is a JSON object with a title or an author. Local: not cut off by length."""
    p = F.col(payload)
    # replies that are no JSON object are kept as they are
    is_object = F.coalesce(F.try_parse_json(p).isNotNull() & p.rlike(r"^\s*\{"), F.lit(False))
    if local:
        reasons = F.from_json(p, "done_reason string, choices array<struct<finish_reason:string>>")
        cut = (F.lower(_blank(reasons["done_reason"])) == "length") | F.exists(F.coalesce(reasons["choices"], F.expr("array()")), lambda c: F.lower(_blank(c["finish_reason"])) == "length")
        return df.filter(~is_object | ~cut)
    content = F.get_json_object(p, "$.choices[0].message.content")
    titled = F.trim(_blank(F.get_json_object(content, "$.title"))) != ""
    authored = F.exists(F.coalesce(F.from_json(F.get_json_object(content, "$.authors"), "array<string>"), F.expr(_NONE)), lambda a: F.trim(_blank(a)) != "")
    failed = F.get_json_object(p, "$._error").isNotNull() | F.get_json_object(p, "$._http_error").isNotNull()
    usable = ~failed & _blank(content).rlike(r"^\s*\{") & (titled | authored)
    return df.filter(~is_object | usable)


def candidates_from_info(df: DataFrame) -> DataFrame:
    """Embedded metadata (doc_id, title, author, subject, keywords, creation_date) → ``pdf_metadata`` candidates."""
    title, author = clean_text(F.col("title")), clean_text(F.col("author"))
    year = first_year(_blank(F.col("subject")), _blank(F.col("keywords")), _blank(F.col("creation_date")))
    out = df.select("doc_id", *_candidate(title, split_authors(author), year, _first(extract_dois(title, author)), _first(extract_isbns(title, author)), _first(extract_arxivs(title, author)), F.lit("pdf_metadata"), 10), author.alias("__a"))
    return out.filter((F.col("title") != "") | (F.col("__a") != "")).drop("__a")


def candidates_from_xmp(df: DataFrame) -> DataFrame:
    """XMP fields (doc_id, dc_title, dc_subject, dc_description, creators, contributors, created, modified) → ``xmp`` candidates."""
    text = [F.nullif(clean_text(F.col(c)), F.lit("")) for c in ("dc_title", "dc_subject", "dc_description")]
    title = F.coalesce(*text, F.lit(""))
    authors = F.concat(_list(F.col("creators")), _list(F.col("contributors")))
    joined = F.array_join(authors, " ")
    year = first_year(_blank(F.col("created")), _blank(F.col("modified")))
    out = df.select("doc_id", *_candidate(title, authors, year, _first(extract_dois(title, joined)), _first(extract_isbns(title, joined)), _first(extract_arxivs(title, joined)), F.lit("xmp"), 5))
    return out.filter((F.col("title") != "") | (F.size("authors") > 0))


def candidates_from_pdfinfo(df: DataFrame, text: str = "info") -> DataFrame:
    """``key: value`` lines → ``pdfinfo`` candidates; software titles and authors are blanked, rows left with neither go."""
    lines = F.filter(F.split(F.col(text), r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), clean_text(F.regexp_extract(x, "^[^:]*:(.*)\\z", 1)).alias("v")))
    # the last value of a key wins
    value = lambda k: _blank(F.try_element_at(F.filter(pairs, lambda p: p["k"] == k), F.lit(-1))["v"])
    rows = df.select("doc_id", value("title").alias("t"), value("author").alias("a"), value("creationdate").alias("c"), value("moddate").alias("m"))
    rows = rows.select("doc_id", F.when(is_software_title(F.col("t")), "").otherwise(F.col("t")).alias("t"), F.when(is_software_author(F.col("a")), "").otherwise(F.col("a")).alias("a"), "c", "m")
    t, a = F.col("t"), F.col("a")
    authors = F.filter(F.transform(split_authors(a), strip_footnote_markers), lambda x: x != "")
    return rows.filter((t != "") | (a != "")).select("doc_id", *_candidate(t, authors, first_year(F.col("c"), F.col("m")), _first(extract_dois(t, a)), _first(extract_isbns(t, a)), _first(extract_arxivs(t, a)), F.lit("pdfinfo"), 15))
