"""The registered queries of the training-data operators; each reads whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm import (
    op1_order_minhash,
    op2_template_removal,
    op3_best_fit,
    op4_binary_ids,
    op5_spaced_seeds,
    op6_line_winnowing,
    op7_pii,
    op8_language_rnn,
    op9_compression_quality,
    op10_bayes_jaccard,
    op11_galloping_alignment,
    op12_license_templates,
    op13_value_dictionaries,
)
from citeweave.llm.common import table


def op1_order_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_order_minhash.order_minhash(table(spark, sf_dir, "documents"))


def op2_template_removal_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_template_removal.main_texts(table(spark, sf_dir, "pages"))


def op3_best_fit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_best_fit.best_fit(table(spark, sf_dir, "documents"))


def op4_binary_ids_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op4_binary_ids.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_spaced_seeds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_spaced_seeds.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_winnowing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_line_winnowing.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii.digest(op7_pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_language_rnn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_language_rnn.languages(table(spark, sf_dir, "documents"))


def op9_compression_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_compression_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bayes_jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_bayes_jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "class_size")


def op11_galloping_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op11_galloping_alignment.token_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_license_templates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_license_templates.license_labels(table(spark, sf_dir, "documents"))


def op13_value_dictionaries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_value_dictionaries.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash_query,
    "op2_template_removal": op2_template_removal_query,
    "op3_best_fit": op3_best_fit_query,
    "op4_binary_ids": op4_binary_ids_query,
    "op5_spaced_seeds": op5_spaced_seeds_query,
    "op6_line_winnowing": op6_line_winnowing_query,
    "op7_pii": op7_pii_query,
    "op8_language_rnn": op8_language_rnn_query,
    "op9_compression_quality": op9_compression_quality_query,
    "op10_bayes_jaccard": op10_bayes_jaccard_query,
    "op11_galloping_alignment": op11_galloping_alignment_query,
    "op12_license_templates": op12_license_templates_query,
    "op13_value_dictionaries": op13_value_dictionaries_query,
}

#: The others can't be said in SQL; their tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op12_license_templates": op12_license_templates.oracle(),
    "op13_value_dictionaries": op13_value_dictionaries.oracle(),
}
