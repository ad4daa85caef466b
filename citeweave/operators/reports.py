"""Reports over result, debug and profile tables: queues, counts, timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeweave.operators.ranks import median
from citeweave.schemas import CANDIDATE_JSON
from citeweave.sources.files import PROVIDERS, parsed_lookups, parsed_searches
from citeweave.storage import stash

# Sources that call for review, and sources that are risky when accepted softly.
BAD_SOURCES = ("error", "none", "filename_title_only", "text_header", "synthesized")
RISKY_SOURCES = ("synthesized", "text_header", "pdfinfo", "grobid")
CORROBORATORS = r"title corroborated by ([0-9]+) strong sources"
SLOW = ("File Wall s", "Resolve Total s", "Title Search s", "Identifier Lookups s", "Vision LLM s", "Vision Pacing s", "Text LLM s", "GROBID s", "OCR Retry s", "OCRMyPDF s")


def name(column: str) -> Column:
    return F.col(f"`{column}`")


def said(column: str) -> Column:
    return F.trim(F.coalesce(name(column), F.lit("")))


def is_yes(column: str) -> Column:
    return F.lower(said(column)) == "yes"


def number(column: str) -> Column:
    """A lenient number: 0 for what is none."""
    return F.coalesce(name(column).try_cast("double"), F.lit(0.0))


def join_debug(results: DataFrame, debug: DataFrame) -> DataFrame:
    """Each result cell, or the debug cell of the same file where it is blank; a file's last debug row (``seq``) counts."""
    cells = [c for c in debug.columns if c not in ("File Path", "seq")]
    last = debug.filter(said("File Path") != "").groupBy("File Path").agg(F.max_by(F.struct(*map(name, cells)), "seq").alias("__d"))
    joined = results.join(last, "File Path", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    both = [F.coalesce(F.nullif(name(c), F.lit("")), F.col("__d")[c], F.lit("")).alias(c) if c in cells else name(c) for c in results.columns]
    return joined.select(*both, *(blank(F.col("__d")[c]).alias(c) for c in cells if c not in results.columns))


def confidence_rank(column: str = "Confidence") -> Column:
    c = F.lower(said(column))
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def numbered(rows: DataFrame, order: list[Column], limit: int, out: str) -> DataFrame:
    """The first ``limit`` rows by ``order`` with a three-digit number; the limit comes first, so one small task numbers."""
    top = rows.orderBy(*order).limit(limit)
    nth = F.row_number().over(Window.orderBy(*order))
    return top.select(F.lpad(nth.cast("string"), 3, "0").alias(out), "*")


def review_queue(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Rows (joined with debug; ``seq`` is the original order, ``missing`` a gone file) from the most to the least pressing."""
    source = F.lower(F.coalesce(F.nullif(said("Source"), F.lit("")), said("Final Source")))
    order = [
        ~F.coalesce("missing", F.lit(False)), said("Error") == "", ~is_yes("Needs OCR"), is_yes("Sanity Passed"), is_yes("Verified"), confidence_rank(), ~source.isin(*BAD_SOURCES), F.col("seq"),
    ]
    return numbered(rows, order, limit, "Review ID")


def corroborators() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("Soft Auto Reasons", CORROBORATORS, 1), F.lit("")).try_cast("int"), F.lit(0))


def has_identifier() -> Column:
    return (said("DOI") != "") | (said("ISBN") != "") | (said("arXiv") != "")


def soft_audit_queue(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Softly accepted rows by risk: missing file, OCR, failed sanity, low score, few corroborators, no identifier, risky source, short title, few authors."""
    kept = rows.filter(F.lower(F.coalesce(F.nullif(said("Soft Auto"), F.lit("")), F.lit("yes"))) == "yes")
    source = F.lower(F.coalesce(F.nullif(said("Final Source"), F.lit("")), said("Source")))
    few = (corroborators() > 0) & (corroborators() <= 2)
    authors = F.size(F.filter(F.split(name("Authors"), r"\s*;\s*|\s+and\s+"), lambda a: F.trim(a) != ""))
    order = [
        ~F.coalesce("missing", F.lit(False)), ~is_yes("Needs OCR"), is_yes("Sanity Passed"), number("Sanity Score"), ~few, has_identifier(), ~source.isin(*RISKY_SOURCES),
        F.size(F.regexp_extract_all("Title", F.lit("([A-Za-z0-9]+)"), F.lit(1))), authors, F.col("seq"),
    ]
    return numbered(kept, order, limit, "Soft ID")


def candidate_evidence(rows: DataFrame, most: int = 8) -> DataFrame:
    """(File Path, pos, source, title, authors, year): named extractors' fields, then the first candidates of the JSON cell."""
    empty = F.expr(f"cast(array() as {CANDIDATE_JSON})")
    named = [F.struct(F.lit(s).alias("source"), *(said(f"{s} {k}").alias(k.lower()) for k in ("Title", "Authors", "Year"))) for s in ("GROBID", "Text LLM", "Vision")]
    shown = F.filter(F.array(*named), lambda x: (x["title"] != "") | (x["authors"] != "") | (x["year"] != ""))
    listed = F.slice(F.coalesce(F.from_json(name("Candidates JSON"), CANDIDATE_JSON), empty), 1, most)
    blank = lambda c, other="": F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    plain = F.transform(
        listed,
        lambda c: F.struct(
            blank(c["source"], "(unknown)").alias("source"), blank(c["title"]).alias("title"),
            blank(F.array_join(F.filter(c["authors"], lambda a: a != ""), "; ")).alias("authors"), blank(c["year"]).alias("year"),
        ),
    )
    return rows.select("File Path", F.posexplode(F.concat(shown, plain)).alias("pos", "e")).select("File Path", "pos", "e.*")


def flagged(results: DataFrame) -> DataFrame:
    """Rows of a result table with the flags that ``run_summary`` counts."""
    flags = {"auto_safe": "Auto Safe", "soft_auto": "Soft Auto", "verified": "Verified", "sanity_passed": "Sanity Passed", "needs_ocr": "Needs OCR", "imported": "Imported"}
    return results.select(*(is_yes(c).alias(k) for k, c in flags.items()), F.lower(said("Confidence")).alias("confidence"))


def run_summary(results: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Counts of a run, one row; with a ``quarantine`` also its lines, as ``unreadable``."""
    if quarantine is not None:
        return run_summary(results).join(quarantine.agg(F.count("*").alias("unreadable")), how="cross")  # a row each
    auto, soft = F.col("auto_safe"), F.col("soft_auto") & ~F.col("auto_safe")
    return results.agg(
        F.count("*").alias("total"), F.count_if(auto).alias("auto_safe"), F.count_if(soft).alias("soft_auto"), F.count_if(~auto & ~soft).alias("review"),
        *(F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")),
        *(F.count_if(F.col(c)).alias(c) for c in ("verified", "sanity_passed", "needs_ocr", "imported")),
    )


def profile_overview(profile: DataFrame) -> DataFrame:
    """Totals and wall times of a profile; the median is exact and comes from counting rounds (``ranks``), not from one task that holds all values."""
    wall = number("File Wall s")
    middle = median(stash(profile.select(wall.alias("wall")), "wall-times"), "wall")
    return profile.agg(
        F.count("*").alias("total"), F.count_if(said("Status") == "processed").alias("processed"), F.count_if(said("Status").startswith("skipped")).alias("skipped"),
        F.count_if(said("Status") == "error").alias("status_error"), F.count_if(said("Error") != "").alias("with_error"), F.coalesce(F.sum(wall), F.lit(0.0)).alias("wall_total"),
        F.coalesce(F.sum(number("Resolve Total s")), F.lit(0.0)).alias("resolve_total"), F.coalesce(F.avg(wall), F.lit(0.0)).alias("wall_mean"),
        F.lit(middle or 0.0).alias("wall_median"), F.coalesce(F.max(wall), F.lit(0.0)).alias("wall_max"),
    )


def value_counts(df: DataFrame, columns: list[str], lower: tuple[str, ...] = ("Confidence",)) -> DataFrame:
    """(column, value, n) of several columns in one scan; blank is ``(blank)``."""
    pairs = [F.struct(F.lit(c).alias("column"), (F.lower(said(c)) if c in lower else said(c)).alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", F.when(F.col("p.value") == "", "(blank)").otherwise(F.col("p.value")).alias("value"))
    return rows.groupBy("column", "value").agg(F.count("*").alias("n"))


def timing_totals(profile: DataFrame) -> DataFrame:
    """(column, seconds, share of wall time) of every column whose name ends in " s"."""
    columns = [c for c in profile.columns if c.endswith(" s")]
    sums = profile.agg(*(F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(c) for c in columns))
    wall = name("File Wall s") if "File Wall s" in columns else F.lit(0.0)
    pairs = [F.struct(F.lit(c).alias("column"), name(c).alias("seconds")) for c in columns]
    rows = sums.select(wall.alias("w"), F.explode(F.array(*pairs)).alias("p"))
    return rows.select("p.column", "p.seconds", F.when(F.col("w") > 0, F.col("p.seconds") / F.col("w")).otherwise(0.0).alias("share"))


def provider_summary(profile: DataFrame) -> DataFrame:
    whole = lambda c: F.floor(number(c))
    rows = [
        F.struct(F.lit(p).alias("provider"), number(f"{p} Search s").alias("seconds"), whole(f"{p} Search Candidates Tried").alias("tried"), whole(f"{p} Search Matches").alias("matches"), whole(f"{p} Search Errors").alias("errors"))
        for p in PROVIDERS.values()
    ]
    sums = profile.select(F.explode(F.array(*rows)).alias("r")).groupBy("r.provider").agg(*(F.sum(f"r.{k}").alias(k) for k in ("seconds", "tried", "matches", "errors")))
    return sums.withColumn("match_rate", F.when(F.col("tried") > 0, F.col("matches") / F.col("tried")).otherwise(0.0))


def identifier_lookup_stats(profile: DataFrame) -> DataFrame:
    """(resolver, kind, lookups, matches, errors) from the JSON cell; a bad cell gives nothing."""
    rows = profile.select(F.explode(parsed_lookups(profile)).alias("l")).select("l.*")
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)")).alias(c)
    return rows.groupBy(named("resolver"), named("kind")).agg(
        F.count("*").alias("lookups"), F.count_if(F.coalesce("matched", F.lit(False))).alias("matches"), F.count_if(F.trim(F.coalesce("error", F.lit(""))) != "").alias("errors")
    )


def title_search_stats(profile: DataFrame) -> DataFrame:
    """(what, text, n): error messages and skip reasons of title searches."""
    rows = profile.select(F.explode(parsed_searches(profile)).alias("s"))
    errors = rows.select(F.lit("error").alias("what"), F.explode("s.error_messages").alias("text"))
    skips = rows.select(F.lit("skip").alias("what"), F.col("s.skip_reason").alias("text"))
    return errors.union(skips).withColumn("text", F.trim("text")).filter("text <> ''").groupBy("what", "text").agg(F.count("*").alias("n"))


def top_errors(profile: DataFrame, k: int = 10) -> DataFrame:
    counts = profile.filter(said("Error") != "").groupBy(said("Error").alias("error")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "error").limit(k)


def top_slowest(profile: DataFrame, columns: tuple[str, ...] = SLOW, k: int = 10) -> DataFrame:
    """(column, nth, File Path, seconds): the k slowest documents of each timing column with time in it.

    Each column is a top-k of its own (partial top-k in every task), so no column's rows are sorted in one place.
    """
    tops = []
    for c in columns:
        rows = profile.select(F.lit(c).alias("column"), number(c).alias("seconds"), "File Path").filter("seconds > 0").orderBy(F.desc("seconds"), "File Path").limit(k)
        tops.append(rows.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("seconds"), "File Path"))))
    return reduce(DataFrame.union, tops)


def queue_summary(items: DataFrame) -> DataFrame:
    """(what, value, n): totals, sources and corroborator counts of a queue."""
    flags = {"rows": F.lit(True), "missing": F.coalesce("missing", F.lit(False)), "needs ocr": is_yes("Needs OCR"), "unverified": ~is_yes("Verified"), "sanity failed": ~is_yes("Sanity Passed")}
    totals = items.agg(*(F.count_if(c).alias(k) for k, c in flags.items())).select(
        F.lit("total").alias("what"), F.explode(F.array(*(F.struct(F.lit(k).alias("value"), name(k).alias("n")) for k in flags))).alias("p")
    )
    source = F.coalesce(F.nullif(said("Final Source"), F.lit("")), F.nullif(said("Source"), F.lit("")), F.lit("(blank)"))
    count = F.when(corroborators() == 0, "unknown").otherwise(corroborators().cast("string"))
    grouped = items.select(F.explode(F.array(F.struct(F.lit("source").alias("what"), source.alias("value")), F.struct(F.lit("corroborators").alias("what"), count.alias("value")))).alias("p"))
    return totals.select("what", "p.*").union(grouped.groupBy("p.what", "p.value").agg(F.count("*").alias("n")))


def response_counts(responses: DataFrame) -> DataFrame:
    return responses.groupBy("namespace").agg(F.count("*").alias("n"))
