"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from citeweave.llm import op1_order_minhash, op2_template_removal, op3_best_fit, op4_binary_ids, op5_spaced_seeds, op6_line_winnowing, op7_pii, op8_language_rnn, op9_compression_quality, op10_bayes_jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, pii string, h int, run int, sig string, rep int, emptied string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGE = [
    (1, None), (2, ""), (3, "   \n "), (None, "an id is missing here and this text goes on for a while to be long enough"), (4, LONG), (5, "x" * 300_000), (6, "7 7 7 7 7 7 7"), (6, "7 7 7 7 7 7 7"),
    (7, "a plain little text that stands twice under two ids"), (8, "a plain little text that stands twice under two ids"), (9, "🙂 é 漢 \x01 end"), (10, "!"), (11, "line\n" * 400),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None, None, None, 0.5, "p", 1, 2, "s", 3, "e") for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a plain little text that stands twice under two ids"), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18")], "item_id long, text string")


def test_op1(edge, empty):
    got = op1_order_minhash.order_minhash(edge).collect()
    assert len(got) == len(EDGE) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[7].fingerprint == by[8].fingerprint and by[1].n_chars == 0
    assert op1_order_minhash.order_minhash(empty).count() == 0


def test_op2(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://a/", "<p>x</p>"), (3, "odd url", "<p>" + "y " * 100_000), (3, "odd url", "<p>" + "y " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, host int, known string")
    got = op2_template_removal.main_texts(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 199_999, 199_999]
    assert op2_template_removal.main_texts(df.limit(0)).count() == 0


def test_op3(edge, empty):
    got = op3_best_fit.best_fit(edge)
    assert got.groupBy("doc_id").count().count() == 12
    assert got.agg(F.sum("n_tokens")).first()[0] == sum(len((t or "").split()) + 1 for _, t in EDGE)
    assert op3_best_fit.best_fit(empty).count() == 0


def test_op4(edge, empty):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    got = op4_binary_ids.token_files(edge, path).orderBy("start").collect()
    assert len(got) == len(EDGE) and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert [r.n_tokens for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert op4_binary_ids.token_files(empty, path).count() == 0


def test_op5(edge, empty, benchmark):
    got = {(r.doc_id, r.item_id) for r in op5_spaced_seeds.overlaps(edge, benchmark).collect()}
    assert got == {(7, 3), (8, 3), (4, None)}
    assert op5_spaced_seeds.overlaps(empty, benchmark).count() == 0
    assert op5_spaced_seeds.overlaps(edge, benchmark.limit(0)).count() == 0


def test_op6(edge, empty):
    got = op6_line_winnowing.without_repeats(edge)
    assert got.columns == [*[c for c in edge.columns if c != "emptied"], "repeats", "emptied"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(EDGE) and by[1].text is None and by[2].text == "" and by[4].text == LONG
    assert by[11].text.strip() == "line" and by[11].repeats
    assert op6_line_winnowing.without_repeats(empty).count() == 0


def test_op7(edge, empty):
    got = op7_pii.digest(op7_pii.pii_spans(edge))
    assert got.count() == len(EDGE) and got.filter("spans <> ''").count() == 0
    assert op7_pii.digest(op7_pii.pii_spans(empty)).count() == 0


def test_op8(spark, edge, empty):
    got = op8_language_rnn.languages(edge).collect()
    assert len(got) == len(EDGE) and {r.lang_pred for r in got} == {"und"}  # no language to learn from
    some = spark.createDataFrame([(i, "the cat sat" if i % 2 else "le chat noir", "en" if i % 2 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    net = op8_language_rnn.train(some)
    named = {r.doc_id: r for r in op8_language_rnn.with_language(edge, net).collect()}
    assert all(named[i].lang_pred == "und" and named[i].score == 0 for i in (1, 2, 3, 6, 10)) and named[7].lang_pred in ("en", "fr")
    assert op8_language_rnn.with_language(empty, net).count() == 0


def test_op9(edge, empty, labels):
    got = {r.doc_id: r for r in op9_compression_quality.quality_scores(edge, labels).collect()}
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[2].score
    assert op9_compression_quality.quality_scores(empty, labels).count() == 0
    assert {r.score for r in op9_compression_quality.quality_scores(edge, labels.limit(0)).collect()} == {0.5}
    model = op9_compression_quality.train(edge, labels)
    assert op9_compression_quality.with_score(edge, model).columns == [*[c for c in edge.columns if c != "score"], "score"]


def test_op10(edge, empty):
    got = op10_bayes_jaccard.near_duplicates(edge).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(EDGE) and (by[8].class_id, by[8].n_links) == (7, 1) and by[1].n_links == 0 and by[1].class_id == 1
    assert [r.n_links for r in got if r.doc_id == 6] == [1, 1]
    kept = op10_bayes_jaccard.without_near_duplicates(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id = 6").count() == 1 and kept.filter("doc_id = 8").count() == 0
    assert op10_bayes_jaccard.near_duplicates(empty).count() == 0
