"""Comparison of two runs, and resuming from an earlier one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.text import basename
from citeweave.operators.ranks import median
from citeweave.operators.reports import is_yes, name, number, said
from citeweave.storage import stash

RESULT_STABLE = (
    "Final Source|Confidence|Verified|Title|Authors|Year|DOI|ISBN|arXiv|Sanity Passed|Sanity Score|Auto Safe|Needs OCR|Soft Auto|Soft Auto Reasons".split("|")
)
#: Tables in which a difference is an error in any mode.
ALWAYS_STRICT = ("profile", "debug")


def file_key() -> Column:
    return basename(F.coalesce(name("File Path"), F.lit("")))


def run_snapshot(run: DataFrame, stable: list[str], json_cells: list[str] = ()) -> DataFrame:
    """(key, n, stable): a row a file name; n over 1 is a duplicate. ``json_ok`` tells whether its JSON cells parse."""
    kept = [c for c in stable if c in run.columns]
    cells = F.to_json(F.struct(*(F.coalesce(name(c), F.lit("")).alias(c) for c in kept)))
    ok = F.lit(True)
    for c in json_cells:
        ok = ok & ((said(c) == "") | F.try_parse_json(name(c)).isNotNull())
    return run.select(file_key().alias("key"), cells.alias("stable"), ok.alias("ok")).groupBy("key").agg(F.count("*").alias("n"), F.max("stable").alias("stable"), F.min("ok").alias("json_ok"))


def compare_runs(base: DataFrame, current: DataFrame, table: str, stable: list[str], mode: str = "cached", json_cells: list[str] = ()) -> DataFrame:
    """(table, what, key, level): missing, added, changed and duplicate files, bad JSON cells, and changed schema or row count.

    A difference of rows is an error in cached mode and in strict tables, else a warning. Only differences come back.
    """
    strict = mode == "cached" or table in ALWAYS_STRICT
    level = "error" if strict else "warning"
    a, b = run_snapshot(base, stable), run_snapshot(current, stable, json_cells)
    both = a.select("key", F.col("stable").alias("was"), F.col("n").alias("n_was")).join(b.select("key", F.col("stable").alias("now"), "n", "json_ok"), "key", "full_outer")
    what = (
        F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when((F.col("n") > 1) | (F.col("n_was") > 1), "duplicate").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    )
    rows_only = level if mode == "cached" else "warning"
    grade = F.when(F.col("what") == "duplicate", "error").when(F.col("what") == "changed", rows_only).otherwise(level)
    rows = both.select("key", what.alias("what")).filter("what IS NOT NULL").select(F.lit(table).alias("table"), "what", "key", grade.alias("level"))
    bad = both.filter(~F.col("json_ok")).select(F.lit(table).alias("table"), F.lit("json").alias("what"), "key", F.lit("error").alias("level"))
    counts = base.agg(F.count("*").alias("a")).crossJoin(current.agg(F.count("*").alias("b"))).filter("a <> b")
    counted = counts.select(F.lit(table).alias("table"), F.lit("row count").alias("what"), F.concat_ws(" -> ", F.col("a").cast("string"), F.col("b").cast("string")).alias("key"), F.lit(level).alias("level"))
    parts = [rows, bad, counted]
    if base.columns != current.columns:
        parts.append(base.sparkSession.sql("SELECT {t} AS `table`, 'schema' AS what, '' AS key, 'error' AS level", t=F.lit(table)))
    return reduce(DataFrame.union, parts)


def timing_summary(profile: DataFrame) -> DataFrame:
    """(total, median, max) of the wall times, one row; the median by counting rounds (``ranks``)."""
    walls = stash(profile.select(number("File Wall s").alias("wall")), "wall-times")
    middle = median(walls, "wall") or 0.0
    return walls.agg(F.coalesce(F.sum("wall"), F.lit(0.0)).alias("total"), F.lit(middle).alias("median"), F.coalesce(F.max("wall"), F.lit(0.0)).alias("max"))


def compare_timing(base: DataFrame, current: DataFrame, mode: str = "cached") -> DataFrame:
    """(what, was, now, allowed, level) of the wall times that grew too much; one-row sums meet, nothing else."""
    both = timing_summary(base).select(*(F.col(c).alias(f"was_{c}") for c in ("total", "median", "max"))).crossJoin(timing_summary(current))
    # Factor, seconds and level of each limit.
    limits = {"total": (2.0, 10.0, "error"), "median": (2.5, 2.0, "warning"), "max": (3.0, 10.0, "warning")} if mode == "cached" else {"total": (2.5, 10.0, "warning")}
    rows = [
        F.struct(F.lit(k).alias("what"), F.col(f"was_{k}").alias("was"), F.col(k).alias("now"), (F.col(f"was_{k}") * f + s).alias("allowed"), F.lit(level).alias("level"))
        for k, (f, s, level) in limits.items()
    ]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("now > allowed")


def compare_response_counts(base: DataFrame, current: DataFrame, mode: str = "cached") -> DataFrame:
    """(namespace, was, now, level): namespaces that shrank in cached mode, or vanished in network mode."""
    both = base.select("namespace", F.col("n").alias("was")).join(current.select("namespace", F.col("n").alias("now")), "namespace", "left").na.fill(0, ["now"])
    lost = F.col("now") < F.col("was") if mode == "cached" else F.col("now") == 0
    return both.filter(lost).withColumn("level", F.lit("error" if mode == "cached" else "warning"))


def previous_rows(tables: list[DataFrame]) -> DataFrame:
    """Result tables with ``table_no`` and ``legacy``: a table without an Auto Safe column is an old one."""
    parts = []
    for i, t in enumerate(tables):
        legacy = "Auto Safe" not in t.columns
        auto = F.lit(False) if legacy else is_yes("Auto Safe")
        parts.append(t.select(said("File Path").alias("File Path"), F.lit(i).alias("table_no"), F.lit(legacy).alias("legacy"), auto.alias("auto"), is_yes("Verified").alias("verified")))
    return reduce(DataFrame.union, parts)


def resume_split(files: DataFrame, previous: DataFrame) -> DataFrame:
    """``files`` (path) with ``done`` and the table that says so; the first table wins. The rest is processed again."""
    kept = previous.filter(F.col("auto") & (F.col("File Path") != "")).groupBy(F.col("File Path").alias("path")).agg(F.min("table_no").alias("table_no"))
    return files.join(kept, "path", "left").withColumn("done", F.col("table_no").isNotNull())


def legacy_count(previous: DataFrame) -> DataFrame:
    return previous.agg(F.count_if(F.col("legacy") & F.col("verified")).alias("legacy"))


def merge_ocr_retry(first: DataFrame, retry: DataFrame) -> DataFrame:
    """The retry's row of a document if anything in it is better, with a note that says what; else the first row."""
    columns = [c for c in first.columns if c != "doc_id"]
    pack = lambda df, k: df.select("doc_id", F.struct(*columns).alias(k))
    both = pack(first, "a").join(pack(retry, "b"), "doc_id", "left")
    rank = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    a, b = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    new = lambda k: (b(k) != "") & (a(k) == "")
    better = [
        F.when(b("verified") & ~a("verified"), "verified"),
        F.when(rank(b("confidence")) > rank(a("confidence")), F.concat(F.lit("confidence "), a("confidence"), F.lit("→"), b("confidence"))),
        F.when(b("sanity_score") > a("sanity_score") + 0.01, F.concat(F.lit("sanity "), F.format_string("%.2f", a("sanity_score")), F.lit("→"), F.format_string("%.2f", b("sanity_score")))),
        *(F.when(new(k), f"new {k}") for k in ("doi", "isbn", "arxiv", "title")),
        F.when((F.size(b("authors")) > 0) & (F.size(a("authors")) == 0), "new authors"),
    ]
    said_better = F.array_join(F.filter(F.array(*better), lambda x: x.isNotNull()), ", ")
    took = F.col("b").isNotNull() & (F.col("why") != "")
    note = F.concat(F.lit("OCR retry recovered metadata ("), F.col("why"), F.lit(") — consider running ocrmypdf to make the original PDF searchable"))
    out = both.withColumn("why", said_better)
    return out.select(
        "doc_id", *(F.when(took, F.array_append(b(k), note)).otherwise(a(k)).alias(k) if k == "notes" else F.when(took, b(k)).otherwise(a(k)).alias(k) for k in columns), took.alias("recovered")
    )


