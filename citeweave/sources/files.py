"""Readers and writers: documents, result tables, profile, debug lines, stored responses, page windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.repair import repair_ligatures
from citeweave.schemas import LOOKUP, TITLE_SEARCH
from citeweave.storage import stash

# Column names of the result and debug tables, and providers as (source, name).
RESULT_COLUMNS = (
    "File Path|Tags|Source|Confidence|Verified|Title|Authors|Year|DOI|ISBN|arXiv|Sanity Passed|Sanity Score|Auto Safe|Needs OCR|Notes|Imported|Error|"
    "Suggested Command|Vision Used|Vision Trigger|Vision Status|Vision Error|Final Source|Soft Auto|Soft Auto Reasons"
).split("|")
PROVIDERS = {"crossref": "Crossref", "openalex": "OpenAlex", "semanticscholar": "Semantic Scholar", "openlibrary": "OpenLibrary", "google_books": "Google Books"}
TRANSIENT = (400, 429, 500, 502, 503, 504)
DEBUG_WORDS = {"llm": "LLM", "http": "HTTP", "json": "JSON", "dpi": "DPI", "doi": "DOI", "isbn": "ISBN", "arxiv": "arXiv", "dois": "DOIs", "isbns": "ISBNs", "arxivs": "arXivs", "grobid": "GROBID", "s": "s"}
DEBUG_FIELDS = (
    "final_source vision_used vision_trigger vision_status vision_error vision_cache_hit vision_attempts vision_http_s vision_retry_sleep_s vision_http_json "
    "vision_prompt_tokens vision_completion_tokens vision_total_tokens vision_provider_total_s vision_provider_queue_s vision_pacing_s vision_tokens_remaining "
    "vision_escalated vision_model vision_pages vision_dpi vision_title vision_authors vision_year text_llm_used text_llm_model text_llm_status text_llm_error "
    "text_llm_cache_hit text_llm_attempts text_llm_http_s text_llm_retry_sleep_s text_llm_pacing_s text_llm_tokens_remaining text_llm_prompt_tokens "
    "text_llm_completion_tokens text_llm_total_tokens text_llm_provider_total_s text_llm_provider_queue_s text_llm_title text_llm_authors text_llm_year "
    "text_llm_doi text_llm_isbn text_llm_arxiv text_llm_http_json grobid_used grobid_title grobid_authors grobid_year local_best_source identifier_dois "
    "identifier_isbns identifier_arxivs candidate_sources candidates_json title_search_queries_json"
).split()
DEBUG_SCHEMA = (
    "file_path string, tags array<string>, imported boolean, error string, suggested_command string, result struct<title:string,authors:array<string>,"
    "year:string,doi:string,isbn:string,arxiv:string,source:string,confidence:string,verified:boolean,sanity_passed:boolean,sanity_score:double,"
    "auto_safe:boolean,soft_auto:boolean,soft_auto_reasons:array<string>,needs_ocr:boolean,notes:array<string>>, debug map<string,string>"
)


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def list_documents(spark: SparkSession, root: str, offset: int = 0, limit: int | None = None, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime) of all files of the pattern below ``root`` by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    out = found.select("path", "length", "modificationTime").orderBy("path").offset(offset)
    return out if limit is None else out.limit(limit)


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab-separated rows as strings; a missing cell is ''."""
    return spark.read.csv(paths, sep="\t", header=True, quote='"', escape='"', multiLine=True, inferSchema=False).na.fill("")


BROKEN = "_corrupt_record"


def set_aside(rows: DataFrame, folder: str, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and those that could not: (table, file, line), written to the quarantine ``folder``; ``rows`` has the corrupt-record column."""
    read = stash(rows.withColumn("__file", F.input_file_name()), table)  # Spark asks for a written table before it tells bad rows apart
    read.filter(F.col(BROKEN).isNotNull()).select(F.lit(table).alias("table"), F.col("__file").alias("file"), F.col(BROKEN).alias("line")).write.parquet(folder)
    return read.filter(F.col(BROKEN).isNull()).drop(BROKEN, "__file"), rows.sparkSession.read.parquet(folder)


def read_checked_results(spark: SparkSession, paths: str | list[str], quarantine: str, columns: list[str] = RESULT_COLUMNS, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``read_results`` of tables with these columns, and the lines that have more or fewer cells, as they stand there, in the new folder ``quarantine``."""
    schema = ", ".join([*(f"`{c}` string" for c in columns), f"{BROKEN} string"])
    rows = spark.read.schema(schema).csv(paths, sep="\t", header=header, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    good, bad = set_aside(rows, quarantine, "results")
    return good.na.fill(""), bad


def read_checked_debug(spark: SparkSession, path: str, quarantine: str) -> tuple[DataFrame, DataFrame]:
    """``read_debug_json``, and the lines that are no JSON of its kind in the new folder ``quarantine``."""
    rows = spark.read.schema(f"{DEBUG_SCHEMA}, {BROKEN} string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN)
    return set_aside(rows, quarantine, "debug")


def checked_responses(responses: DataFrame, quarantine: str) -> tuple[DataFrame, DataFrame]:
    """``valid_responses``, and the responses whose payload is no JSON in the new folder ``quarantine``."""
    rows = responses.withColumn(BROKEN, F.when(F.try_parse_json("payload").isNull(), F.col("payload")))
    good, bad = set_aside(rows, quarantine, "responses")
    return valid_responses(good), bad


def three_decimals(c: Column) -> Column:
    """A number with three decimals, rounded by its binary value, ties to even, as C and Python print it; Java rounds the decimal text up."""
    size = F.abs(c)
    k = F.floor(size * 1000)
    # size * 2000 against the odd number between k and k + 1, without rounding: a float has 24 bits, and what it leaves 29
    head = size.cast("float").cast("double")
    above = (head * 2000 - (2 * k + 1)) + (size - head) * 2000
    exact = (k + F.when((above > 0) | ((above == 0) & (k % 2 == 1)), 1).otherwise(0)) / 1000
    return F.format_string("%.3f", F.when(size < 1e9, F.when(c < 0, -exact).otherwise(exact)).otherwise(c))


def result_rows(results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """schemas.RESULT with path and tags → the 26 text columns of a result table, behind the columns to keep."""
    of = lambda c: F.coalesce(F.col(c), F.lit("")) if c in results.columns else F.lit("")
    flag = lambda c: yes_no(F.col(c)) if c in results.columns else F.lit("no")
    values = {
        "File Path": of("path"), "Tags": F.array_join("tags", ", "), "Authors": F.array_join("authors", "; "), "Sanity Score": three_decimals(F.col("sanity_score")),
        "Notes": F.array_join("notes", " | "), "Soft Auto Reasons": F.array_join("soft_auto_reasons", " | "), "DOI": of("doi"), "ISBN": of("isbn"), "arXiv": of("arxiv"),
        "Final Source": of("source"), "Vision Status": F.coalesce(F.nullif(of("vision_status"), F.lit("")), F.lit("not_attempted")),
    }
    flags = {"Verified": "verified", "Sanity Passed": "sanity_passed", "Auto Safe": "auto_safe", "Needs OCR": "needs_ocr", "Imported": "imported", "Soft Auto": "soft_auto", "Vision Used": "vision_used"}
    values |= {k: flag(v) for k, v in flags.items()}
    return results.select(*(keep or []), *(values.get(c, of(c.lower().replace(" ", "_"))).alias(c) for c in RESULT_COLUMNS))


def routes(auto_safe: Column, soft_auto: Column) -> Column:
    """Which tables a row goes to: auto; auto and soft; review."""
    return F.when(auto_safe, F.array(F.lit("auto"))).when(soft_auto, F.array(F.lit("auto"), F.lit("soft"))).otherwise(F.array(F.lit("review")))


def write_routed(results: DataFrame, base: str, mode: str = "overwrite") -> None:
    """One pass over the results: rows exploded by route; the three tables are the folders ``route=…`` of ``base``."""
    rows = result_rows(results.withColumn("route", F.explode(routes(F.col("auto_safe"), F.col("soft_auto")))), ["route"])
    rows.write.mode(mode).partitionBy("route").csv(base, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def profile_rows(timings: DataFrame) -> DataFrame:
    """(path, status, …, lookups, searches) → profile columns: per provider its last search's figures, zeros where there is none."""
    fixed = lambda c: F.format_string("%.6f", F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    columns = []
    for source, name in PROVIDERS.items():
        last = F.try_element_at(F.filter("searches", lambda s: s["source"] == source), F.lit(-1))
        columns.append(fixed(last["elapsed_s"]).alias(f"{name} Search s"))
        for field, label in (("candidates_tried", "Candidates Tried"), ("matches_returned", "Matches"), ("errors", "Errors")):
            columns.append(F.coalesce(last[field], F.lit(0)).cast("string").alias(f"{name} Search {label}"))
    plain = [c for c in timings.columns if c not in ("lookups", "searches")]
    return timings.select(
        *plain, F.size("lookups").cast("string").alias("Identifier Lookup Count"), F.to_json("lookups").alias("Identifier Lookups JSON"), *columns, F.to_json("searches").alias("Title Searches JSON")
    )


def write_profile(timings: DataFrame, path: str) -> None:
    profile_rows(timings).write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return read_results(spark, path)


def parsed_lookups(profile: DataFrame) -> Column:
    """The lookups cell as an array; null for bad JSON."""
    return F.from_json(F.col("Identifier Lookups JSON"), f"array<struct<{LOOKUP.replace(' ', ':').replace(',:', ',')}>>")


def parsed_searches(profile: DataFrame) -> Column:
    return F.from_json(F.col("Title Searches JSON"), f"array<struct<{TITLE_SEARCH.replace(' ', ':').replace(',:', ',')}>>")


def write_debug_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_debug_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEBUG_SCHEMA).json(path)


def debug_label(field: str) -> str:
    return " ".join(DEBUG_WORDS.get(w, w.capitalize()) for w in field.split("_"))


def flatten_debug(records: DataFrame) -> DataFrame:
    """Nested debug records → flat text columns: yes/no, joined lists, '' where nothing is said."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    r = lambda k: F.col(f"result.{k}")
    flat = {
        "File Path": blank(F.col("file_path")), "Tags": F.coalesce(F.array_join("tags", ", "), F.lit("")), "Imported": yes_no(F.col("imported")), "Error": blank(F.col("error")),
        "Suggested Command": blank(F.col("suggested_command")), "Title": blank(r("title")), "Authors": F.coalesce(F.array_join(r("authors"), "; "), F.lit("")), "Year": blank(r("year")),
        "DOI": blank(r("doi")), "ISBN": blank(r("isbn")), "arXiv": blank(r("arxiv")), "Source": blank(r("source")), "Confidence": blank(r("confidence")), "Verified": yes_no(r("verified")),
        "Sanity Passed": yes_no(r("sanity_passed")), "Sanity Score": blank(r("sanity_score")), "Auto Safe": yes_no(r("auto_safe")), "Needs OCR": yes_no(r("needs_ocr")),
        "Notes": F.coalesce(F.array_join(r("notes"), " | "), F.lit("")), "Soft Auto": yes_no(r("soft_auto")), "Soft Auto Reasons": F.coalesce(F.array_join(r("soft_auto_reasons"), " | "), F.lit("")),
    }
    return records.select(*(c.alias(k) for k, c in flat.items()), *(blank(F.trim(F.col("debug")[f])).alias(debug_label(f)) for f in DEBUG_FIELDS))


def page_windows(pages: DataFrame, n_text: int = 2, n_ident: int = 8, n_sanity: int = 5) -> DataFrame:
    """(doc_id, page_no, text) → text, ident_text and sanity_text of each document's first pages; the first and last repaired."""
    most = max(n_text, n_ident, n_sanity)
    listed = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    folded = pages.filter(F.col("page_no") <= most).groupBy("doc_id").agg(listed.alias("p"))
    first = lambda n: F.array_join(F.transform(F.filter("p", lambda x: x["page_no"] <= n), lambda x: x["text"]), "\n")
    windows = folded.select("doc_id", first(n_text).alias("t"), first(max(n_ident, n_text)).alias("ident_text"), first(max(n_sanity, n_text)).alias("s"))
    repaired = windows.select("doc_id", repair_ligatures(F.col("t")).alias("text"), "ident_text", repair_ligatures(F.col("s")).alias("s"))
    return repaired.select("doc_id", "text", "ident_text", F.when(F.trim("s") == "", F.col("text")).otherwise(F.col("s")).alias("sanity_text"))


def read_responses(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, key_sha1, payload) of ``root/<namespace>/<sha1>.json``."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.input_file_name()
    return texts.select(F.regexp_extract(path, r"([^/]+)/[^/]+\.json\z", 1).alias("namespace"), F.regexp_extract(path, r"([^/]+)\.json\z", 1).alias("key_sha1"), F.col("value").alias("payload"))


def _transient(p: Column) -> Column:
    code = F.get_json_object(p, "$._http_error").try_cast("int")
    return F.coalesce(code.isin(*TRANSIENT), F.lit(False))


def _has(p: Column, field: str) -> Column:
    """Whether a JSON object has the field, be it null."""
    return F.array_contains(F.coalesce(F.json_object_keys(p), F.expr("cast(array() as array<string>)")), field)


def purge_errors(responses: DataFrame) -> DataFrame:
    """Responses left when errors are purged: parsable, no ``_error``, no empty ``_text``, no transient HTTP error."""
    p = F.col("payload")
    empty = _has(p, "_text") & (F.coalesce(F.get_json_object(p, "$._text"), F.lit("")) == "")
    return responses.filter(F.try_parse_json(p).isNotNull() & ~_has(p, "_error") & ~empty & ~_transient(p))


def valid_responses(responses: DataFrame) -> DataFrame:
    """Responses worth storing: parsable, no ``_error``, no transient HTTP error; ``_text`` is not looked at."""
    p = F.col("payload")
    return responses.filter(F.try_parse_json(p).isNotNull() & ~_has(p, "_error") & ~_transient(p))
