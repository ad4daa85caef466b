"""Corpus pipeline: quality classifier, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and is written as Parquet before
the next reads it. All but the last return the columns of ``documents`` as they came, ``text`` shortened by line dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import op3_best_fit, op5_spaced_seeds, op6_line_winnowing, op9_compression_quality, op10_bayes_jaccard
from citeweave.llm.common import row_key, stash, table

#: Documents below this quality score go.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = op9_compression_quality.train(docs, table(spark, sf_dir, "labels"))
    return op9_compression_quality.with_score(docs, model, "__score").filter(F.col("__score") >= QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; a document that consists of repeats goes."""
    return op6_line_winnowing.without_repeats(docs, flags=("__repeats", "__emptied")).filter(~F.col("__emptied")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id's document of each class of near duplicates."""
    return op10_bayes_jaccard.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    keyed = docs.withColumn("__row", row_key())
    hit = op5_spaced_seeds.overlaps(keyed.select(F.col("__row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = stash(hit.select(F.col("doc_id").alias("__row")).distinct(), "leaks")
    return keyed.join(found, "__row", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence."""
    return op3_best_fit.best_fit(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: No stage of these can be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
