"""What must not grow with the input, or be done again for each rule that asks for it."""

from pyspark.sql import functions as F

CANDIDATE_ROW = "doc_id long, pos int, title string, authors array<string>, year string, doi string, isbn string, arxiv string, source string, priority int, notes array<string>"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_synthesis_normalises_a_title_once(spark):
    from citeweave.operators import candidates as cands

    rows = spark.createDataFrame([(1, 0, "On waves in water", ["Ann Reed"], "", "", "", "", "grobid", 12, [])], CANDIDATE_ROW)
    assert optimized(cands.synthesize(rows)).count("edition|ed") <= 4


def test_blanks_at_the_ends_of_a_text(spark):
    from citeweave.functions import text as tx

    every = "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in every], "t string")
    assert rows.filter(~tx.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+\z", ""))).count() == 0


def test_arrivals_are_written_by_all_tasks(spark, sf, tmp_path, monkeypatch):
    from citeweave.plans import queries_sources as qs

    class Done:
        def awaitTermination(self):
            pass

    monkeypatch.setattr(qs, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(qs, "incremental_resolve", lambda *a, **k: Done())
    monkeypatch.setattr(qs, "keyed", lambda entries: entries)
    qs.k1_repeated(spark, sf)
    assert len(list(tmp_path.glob("k1-in/*.parquet"))) > 3


def test_compaction_writes_as_many_files_as_the_size_asks_for(spark, tmp_path, monkeypatch):
    from citeweave.streaming import published

    monkeypatch.setattr(published, "FILE_BYTES", 2000)
    for n in range(2):
        published.publish(spark.range(n * 2000, (n + 1) * 2000, numPartitions=4).selectExpr("id", "'r' AS route"), str(tmp_path), n, ["route"])
    assert published.compact(spark, str(tmp_path), "id long, route string", ["route"]) == 2
    now = published.read_published(spark, str(tmp_path), "id long, route string")
    assert now.count() == 4000 and len(now.inputFiles()) > 1


def test_title_search_normalises_either_side_once(spark):
    from citeweave.operators import search

    q = spark.createDataFrame([(1, 1, 1, "On waves in water", ["Ann Reed"], "")], "qid long, doc_id long, nth int, title string, authors array<string>, year string")
    k = spark.createDataFrame([(7, "crossref_search", "On waves in water", ["Ann Reed"], "", "", "", "", "")], "eid long, source string, title string, authors array<string>, year string, doi string, isbn string, arxiv string, publisher string")
    found = search.title_search(q, k, spelling=False)
    assert "edition|ed" not in optimized(found) and [r.eid for r in found.collect()] == [7]


def test_file_names_are_cut_once_for_all_identifiers(spark):
    from citeweave.operators import candidates as cands

    docs = spark.createDataFrame([(1, "/a/arXiv 2001.00001 b.pdf", "See doi:10.1000/X1. stable/12 and (S0022-0000(99)00001-2).", "more stable/13")], "doc_id long, path string, text string, ident_text string")
    found = cands.text_identifiers(docs)
    assert optimized(found).count(r"([^/\\]*+)") <= 2
    row = found.first()
    assert (row.stem, row.d, row.a, row.s) == ("arXiv 2001.00001 b", ["10.1000/X1", "10.1016/S0022-0000(99)00001-2"], ["2001.00001"], ["stable/12", "stable/13"])


def test_readable_texts_by_their_definition(spark):
    import random
    import re

    from citeweave.functions.quality import FUNCTION_WORDS, is_unreadable_text

    r = random.Random(7)
    odd = ["xq", "Zz9", "é", "the_", "été", "i", "-", "of,", "\n", "q" * 40]

    def text():
        share, n = r.choice((0.0, 0.03, 0.04, 0.05, 0.3, 0.9)), r.choice((20, 60, 100, 300, 900))
        return "".join(r.choice(FUNCTION_WORDS if r.random() < share else odd) + r.choice(("", " ", " ", " ", "  ", ".")) for _ in range(n))

    def wanted(t):
        words = re.findall(r"\b([a-z]+)\b", t[:3000].lower())
        return len(t.strip()) < 200 or len(words) < 30 or sum(w in FUNCTION_WORDS for w in words) / len(words) < 0.04

    texts = [(text(),) for _ in range(600)]
    got = spark.createDataFrame(texts, "t string").select("t", is_unreadable_text(F.col("t")).alias("u")).collect()
    assert [x.t for x in got if x.u != wanted(x.t)] == [] and 50 < sum(x.u for x in got) < len(got) - 50


def test_separators_and_archive_names(spark):
    import itertools

    from citeweave.functions import text as tx

    texts = [("".join(x),) for x in itertools.product(" -é\na1", repeat=6)]
    rows = spark.createDataFrame(texts, "t string")
    assert rows.filter(tx.normalize_for_sanity(F.col("t")) != F.trim(F.regexp_replace("t", "[^a-z0-9]+", " "))).count() == 0
    names = ["/x/Anna's Archive-12 Waves.pdf", "annas archive" + "0F" * 16, "a LibGen.lc b.PDF", "0a" * 16 + ".pdf", "0a" * 17 + ".pdf", "Plain_name.pdf"]
    got = [x.n for x in spark.createDataFrame([(n,) for n in names], "p string").select(tx.normalize_filename(F.col("p")).alias("n")).collect()]
    assert got == ["waves", "", "a b", "", "0a" * 17, "plain name"]


def test_rules_read_results_that_are_resolved_once(spark, sf, monkeypatch):
    from citeweave.plans import queries_decide as qd

    monkeypatch.setattr(qd.jobs, "identifier_resolution", lambda *a: spark.range(9).selectExpr("id AS doc_id", "'crossref_doi' AS source", "true AS sanity_passed"))
    made = qd.results(spark, sf)
    assert made.inputFiles() and all("/results-" in f for f in made.inputFiles())
    assert {r.source for r in made.collect()} == {"crossref_doi", "crossref_search"}


def test_worklist_reads_texts_once(spark, sf, monkeypatch):
    from citeweave.plans import queries_decide as qd

    monkeypatch.setattr(qd.jobs, "best_of_pool", lambda *a: spark.range(9).selectExpr("id AS doc_id", "true AS sanity_passed"), raising=False)
    monkeypatch.setattr(qd.jobs, "identifier_resolution", lambda *a: spark.range(9).selectExpr("id AS doc_id", "true AS sanity_passed"))
    assert "regexp_extract_all" not in optimized(qd.h9(spark, sf))


def test_flags_of_titles_travel_with_candidates(spark, tmp_path):
    """Candidates that are combined round after round are asked about their titles once; what is made of them has its title's flags and is what it is without."""
    from citeweave.operators import candidates as cands

    titles = ["On waves in water", "J Appl Phys", "We study waves at the university", "", "Waves, 2nd edition"]
    rows = spark.createDataFrame([(k, pos, t, ["Ann Reed"], "2001", "", "", "", ("grobid", "pdfinfo")[pos], 12 + pos, []) for k, t in enumerate(titles) for pos in range(2)], CANDIDATE_ROW)
    cands.with_synthesis_flags(rows).write.parquet(f"{tmp_path}/flagged")
    made = cands.synthesize(spark.read.parquet(f"{tmp_path}/flagged"))
    assert "edition|ed" not in optimized(made)
    plain = cands.synthesize(rows)
    assert [r.asDict() for r in made.drop("__t", "__odd").orderBy("doc_id").collect()] == [r.asDict() for r in plain.orderBy("doc_id").collect()] and len(made.columns) == len(plain.columns) + 2
    assert made.collect() == cands.with_synthesis_flags(made.drop("__t", "__odd")).collect()


def test_evidence_of_a_round_is_written_once(spark, monkeypatch):
    """Matches of both kinds read what candidates say of them from one table."""
    from citeweave.plans import phases

    docs = spark.createDataFrame([(1, "/a/b.pdf", "On waves in water. doi:10.1/1", "", "")], "doc_id long, path string, text string, ident_text string, sanity_text string")
    rows = spark.createDataFrame([(1, 1, 100000, "On waves in water", ["Ann Reed"], "", "", "", "", "pdfinfo", 15, [])], "doc_id long, stage int, pos int, title string, authors array<string>, year string, doi string, isbn string, arxiv string, source string, priority int, notes array<string>")
    entries = spark.createDataFrame([("crossref_doi", "On waves in water", ["Ann Reed"], "", "10.1/1", "", "", "")], "source string, title string, authors array<string>, year string, doi string, isbn string, arxiv string, publisher string")
    rounds, seen = phases.Rounds(docs, rows, entries, "safe", True), []
    plain = phases.stash
    monkeypatch.setattr(phases, "stash", lambda df, name: (seen.append((name, optimized(df))), plain(df, name))[1])
    local = rounds.add(rounds.arriving(phases.LOCAL, rounds.docs), "local")
    rounds.look_up([local])
    judged = [plan for name, plan in seen if name == "judged"]
    assert judged and "levenshtein" not in judged[0]  # that of titles is in the table's own plan
    assert rounds.settled[0].count() + rounds.state.count() == 1
