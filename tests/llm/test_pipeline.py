"""The pipeline's stages, each judged on what it was given."""

import re

import pytest

from citeweave.llm import op5_spaced_seeds, op6_line_winnowing, op10_bayes_jaccard
from citeweave.llm.common import stash


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], sf), re.sub(r"\W", "-", name)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_quality_keeps_good_documents(spark, sf, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()} & set(texts(stages[0]))
    kept = set(texts(stages[1]))
    assert len(good & kept) >= 0.97 * len(good) and kept < set(texts(stages[0]))


def test_line_dedup_keeps_first_copies(stages):
    before, after = texts(stages[1]), texts(stages[2])
    units = lambda rows: {u for t in rows.values() for u in op6_line_winnowing.hashes(t or "")[0].tolist()}
    assert units(before) == units(after) and set(after) <= set(before)


def test_one_of_each_class(stages):
    from tests.llm.test_operators import _classes

    before, after = texts(stages[2]), texts(stages[3])
    want = {c for c, _ in _classes({i: t or "" for i, t in before.items()}).values()}
    assert set(after) == want and all(after[i] == before[i] for i in after)
    assert all(n == 0 for i, (_, n) in _classes({i: t or "" for i, t in after.items()}).items())


def test_no_leaks_left(spark, sf, stages):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaks = {r.doc_id for r in op5_spaced_seeds.overlaps(stages[3], benchmark).collect()}
    assert set(texts(stages[4])) == set(texts(stages[3])) - leaks


def test_everything_is_packed(spark, sf, stages):
    import corpus_pipeline

    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == set(texts(stages[4]))
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").split()) + 1 for t in texts(stages[4]).values())
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
    assert op10_bayes_jaccard.THRESHOLD == 0.8


def test_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, an empty table, and columns with the names that stages use themselves."""
    import corpus_pipeline

    text = "A text of some words. It goes on for a while so that it has shingles and lines. " * 3
    rows = [(1, text), (1, text), (None, text + "More."), (2, None), (3, ""), (4, "short"), (5, " \n "), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 0.5, True, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row string, __score double, __emptied boolean, __repeats boolean")
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "quite another passage of the benchmark"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = stash(start, "edges")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stash(stage(spark, now, sf), "edges-" + re.sub(r"\W", "-", name))
            assert out.columns == docs.columns and out.count() <= now.count(), name
            now = out
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
