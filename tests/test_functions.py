"""Column functions and operators against plain Python on small rows of our own."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeweave.functions import identifiers, quality, repair, similarity
from citeweave.functions import text as tx
from citeweave.operators import candidates as cands
from citeweave.operators import decide, extract, lookup
from citeweave.schemas import CANDIDATE


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "raw, names",
    [
        ("Ann Reed; Bo Stone (eds.)", ["Ann Reed", "Bo Stone"]),
        ("Reed, Ann, Stone, Bo", ["Ann Reed", "Bo Stone"]),
        ("Ann Reed and Bo Stone", ["Ann Reed", "Bo Stone"]),
        ("Anders Andersson", ["Anders Andersson"]),
        ("Reed, Ann", ["Reed", "Ann"]),
        ("Ann Reed · Bo Stone", ["Ann Reed", "Bo Stone"]),
        ("", []),
        (None, []),
    ],
)
def test_split_authors(spark, raw, names):
    assert apply(spark, tx.split_authors, [raw]) == [names]


def test_text(spark):
    assert apply(spark, tx.clean_text, [" a \t b\x07c ", None]) == ["a b c", ""]
    assert apply(spark, tx.normalize_title, ["Optics & Waves, 2nd Edition, vol. 3"]) == ["optics and waves 2nd 3"]
    assert apply(spark, tx.strip_footnote_markers, ["Ann Reed†12, Bo*"]) == ["Ann Reed, Bo"]
    assert apply(spark, tx.decamelize, ["deepNetsABCd2x"]) == ["deep Nets AB Cd 2 x"]
    assert apply(spark, tx.clean_filename_text, ["[Series] big-book-of-many-things", "NIPS-2019-deepNets (2)"]) == ["big book of many things", "deep Nets"]
    assert [tuple(r) for r in apply(spark, tx.strip_title_metadata, ["Waves (2020, Some Press)", "Waves [1999, x", "Waves"])] == [("Waves", "2020"), ("Waves", "1999"), ("Waves", "")]
    assert apply(spark, lambda c: tx.path_tags("/lib", c), ["/lib/physics/2020/a,b/x.pdf", "/lib/x.pdf", "/lib/12.3/x.pdf"]) == [["physics", "a b"], ["imported"], ["imported"]]
    assert apply(spark, tx.author_surname, ["Reed, A. B.", "Ann  de la Cruz", "A B"]) == ["reed", "cruz", ""]


def test_identifiers(spark):
    text = "see 10.1000/Ab.c-1, (10.1000/xyz). old arXiv:math.GT/0309136v2 new 2001.01234 not stable/1234567 and ISBN 0-306-40615-2, 978-0-306-40615-7"
    assert apply(spark, identifiers.extract_dois, [text]) == [["10.1000/Ab.c-1", "10.1000/xyz"]]
    assert apply(spark, identifiers.extract_isbns, [text]) == [["0306406152", "9780306406157"]]
    assert apply(spark, identifiers.extract_arxivs, [text]) == [["math.GT/0309136v2", "2001.01234"]]
    assert apply(spark, identifiers.extract_stable_ids, [text]) == [["stable/1234567"]]
    assert apply(spark, identifiers.validate_isbn, ["080442957x", "080442957X", "0804429571", "12"]) == ["080442957X", "080442957X", "", ""]
    assert apply(spark, identifiers.pii_to_doi, ["S0049-237X(08)71107-8", "S0304397508001234"])[0] == "10.1016/S0049-237X(08)71107-8"


# own example strings for each predicate
@pytest.mark.parametrize(
    "predicate, yes, no",
    [
        (quality.is_garbage_title, ["", "J. Smith", "ABC", "This paper shows x", "March 3, 2011", "??!!", "1999, Vol 3"], ["On the growth of trees", "Waves"]),
        (quality.is_series_banner, ["Lecture Notes in Geology", "Universitext"], ["Notes on lectures", "Universitexts"]),
        (quality.is_software_title, ["draft.tex", "http://a.b", "Untitled 3", "ISO 15930"], ["The text book"]),
        (quality.is_software_author, ["operator", " ", "layout.indd"], ["Reed", "Ann Reed"]),
        (quality.is_journal_header, ["Journal of Trees", "Annals of Wood and many other odd things 1999", "Tree Letters 12 (1999)", "a_b.dvi"], ["A journal on trees"]),
        (quality.is_journal_abbrev, ["Ann. Stat. - 1999", "JASA", "J Appl Wood"], ["J. Reed on wood", "Wood 1999"]),
        (quality.is_suspicious_title, ["University of Wood", "a@b.c", "We study wood", "x" * 181], ["Wood in summer"]),
        (quality.is_noise_line, ["Downloaded from x", "12", "doi: 1", "Vol. 3 no 4 1999"], ["Wood downloads"]),
        (quality.looks_like_authors, ["Ann Reed, Bo Stone", "ANN REED"], ["Edited by:", "and others", "A SERIES OF BOOKS", "Springer Series in Wood"]),
    ],
)
def test_predicates(spark, predicate, yes, no):
    assert apply(spark, predicate, yes) == [True] * len(yes)
    assert apply(spark, predicate, no) == [False] * len(no)


def test_similarity_is_difflibs(spark):
    pairs = [("On waves in wood", "On waves in woods"), ("a b c", "c b a"), ("Waves", "waves!"), ("", "x"), ("Deep nets for trees", "Trees")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(similarity.title_similarity(F.col("a"), F.col("b"))).collect()]

    def want(a, b):
        x, y = (re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in (a, b))
        if not x or not y:
            return 0.0
        u, v = set(x.split()), set(y.split())
        return 1.0 if x == y else max(SequenceMatcher(None, x, y).ratio(), len(u & v) / len(u | v))

    assert got == pytest.approx([want(*p) for p in pairs])


def test_ligatures(spark):
    assert apply(spark, repair.repair_ligatures, ["T Rees F Low C Ode", "T Rees only"]) == ["Trees Flow Code", "T Rees only"]
    assert apply(spark, repair.repair_title_ligatures, ["E Fficient F Low the Ory"]) == ["Efficient Flow the Ory"]


def test_filename_candidates(spark):
    names = {
        0: "/l/Waves in Wood (2019, Press) -- Ann Reed -- 2019 -- 9780306406157 -- 0123456789abcdef0123456789abcdef.pdf",
        1: "/l/(Big Series) Ann Reed_Bo Stone - Waves in Wood (2011, Press).pdf", 2: "/l/Ann Reed - Waves in Wood.pdf", 3: "/l/Ann Reed - JASA WOOD - 1999.pdf", 4: "/l/waves_in_wood.pdf",
    }
    df = spark.createDataFrame(list(names.items()), "doc_id long, path string")
    got = {(r.doc_id, r.source): r for r in extract.candidates_from_filename(df).collect()}
    assert (got[0, "filename_structured"].title, got[0, "filename_structured"].isbn, got[0, "filename_structured"].year) == ("Waves in Wood", "9780306406157", "2019")
    assert got[0, "filename_structured"].authors == ["Ann Reed"]
    assert got[1, "filename_series"].authors == ["Ann Reed", "Bo Stone"] and got[1, "filename_series"].year == "2011"
    assert got[2, "filename_author_title"].title == "Waves in Wood"
    assert (3, "filename_author_only") in got and (3, "filename_title_only") in got
    assert got[4, "filename_title_only"].title == "waves in wood"


def test_header_lines(spark):
    texts = [
        "Downloaded from x\n\nWAVES IN WOOD\nAnn Reed, Bo Stone\nAbstract", "Journal of Wood\nOn waves in wood\nAnn Reed\n", "12\n", "STATE-OF-ART: WOOD\r\nA SECOND LINE\nAuthor(s): Ann Reed\nBo",
        "W A V E S\nThe growth of trees\nabstract:", "Published as a conference paper at X 1999: Waves in deep wood\nAnn Reed", "short\ntiny", "Proceedings of wood in summer\n1999\nJournal of Wood", None, "", "x\u2028On waves and wood",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.h.title, r.h.authors, r.h.head != "") for r in extract.with_header(df).orderBy("doc_id").collect()]
    assert got == [
        ("Waves In Wood", "Ann Reed, Bo Stone", True), ("On waves in wood", "Ann Reed", True), ("", "", False), ("State-Of-Art: Wood: A Second Line", "Ann Reed", True), ("The growth of trees", "", True),
        ("Ann Reed", "", True), ("short", "tiny", True), ("", "Journal of Wood", True), ("", "", False), ("", "", False), ("On waves and wood", "", True),
    ]


def test_ligatures_against_plain_python(spark):
    """Pairs of words of all kinds in a row, joined by regular expressions with a function."""
    import random

    rng = random.Random(4)
    words = ["B", "F", "I", "A", "Xyz", "Low", "the", "The", "Ab", "cde", "Fgh", "É", "Éa", "(B", "Ode)", "C", "Re", "Longer", "x1", "_B"]
    texts = [(" " if k % 2 else "  ").join(rng.choice(words) for _ in range(rng.randint(1, 14))) for k in range(400)]
    low = lambda m: m[1] + m[2].lower()

    def title(t):
        if len(re.findall(repair.TITLE_SPLIT, t)) < 2:
            return t
        t = re.sub(repair.TITLE_SPLIT, low, t)
        for _ in range(repair.ROUNDS):
            t = re.sub(repair.FRAGMENT, lambda m: m[0] if m[1].lower() in repair.STAY_APART else low(m), t)
        return t

    assert apply(spark, repair.repair_title_ligatures, texts) == [title(t) for t in texts]
    assert apply(spark, repair.repair_ligatures, texts) == [re.sub(repair.TEXT_SPLIT, low, t) if len(re.findall(repair.TEXT_SPLIT, t)) >= 3 else t for t in texts]


def candidate(pos, source, title, authors=(), year="", doi="", priority=10):
    return (1, pos, 0, title, list(authors), year, doi, "", "", source, priority, [])


def result(spark, **changed):
    base = dict(
        doc_id=1, title="Waves in tropical wood", authors=["Ann Reed"], year="2011", doi="10.1/a", isbn="", arxiv="", publisher="", source="crossref_doi", confidence="high", verified=True, sanity_passed=True,
        sanity_score=0.8, needs_ocr=False, auto_safe=False, notes=[],
    )
    shape = "doc_id long, title string, authors array<string>, year string, doi string, isbn string, arxiv string, publisher string, source string, confidence string, verified boolean, sanity_passed boolean, sanity_score double, needs_ocr boolean, auto_safe boolean, notes array<string>"
    return spark.createDataFrame([tuple((base | changed).values())], shape)


@pytest.mark.parametrize(
    "source, title, authors, year, accepted, review",
    [
        ("grobid", "Waves in tropical wood", ["A. Reed"], "", True, False),
        ("grobid", "Waves in tropical wood: a long study of oaks and beeches in the far south", ["Ann Reed"], "2011", True, False),
        ("filename_structured", "Waves in tropical wood: a long study of oaks and beeches in the far south", ["Ann Reed"], "", True, True),
        ("grobid", "Waves in tropical wood: a long study of oaks and beeches in the far south", ["Ann Reed"], "1999", False, False),
        ("grobid", "Waves in tropical wood", ["Bo Stone"], "", False, False),
        ("filename_title_only", "Waves in tropical wood", ["Ann Reed"], "", False, False),
    ],
)
def test_corroboration(spark, source, title, authors, year, accepted, review):
    c = spark.createDataFrame([candidate(0, source, title, authors, year)], CANDIDATE)
    got = decide.corroboration_decision(result(spark), c).first()
    assert (got.accepted, got.force_review) == (accepted, review)


def test_soft_auto_and_rescue(spark):
    c = spark.createDataFrame([candidate(0, "grobid", "Waves in tropical wood", ["Ann Reed"]), candidate(1, "pdfinfo", "Waves in Tropical Wood", []), candidate(2, "pdfinfo", "Waves in tropical wood", ["Ann Reed"])], CANDIDATE)
    got = decide.soft_auto(result(spark), c).first()
    assert got.soft_auto and got.soft_auto_reasons == ["title corroborated by 2 strong sources (grobid, pdfinfo); authors corroborated by grobid"]
    assert not decide.soft_auto(result(spark, needs_ocr=True), c).first().soft_auto
    failed = result(spark, source="crossref_search", sanity_passed=False, sanity_score=0.1)
    saved = decide.rescue_match(failed, c).first()
    assert saved.sanity_passed and saved.sanity_score == 0.6
    down = decide.downgrade_failed(failed).first()
    assert (down.verified, down.confidence) == (False, "medium")


def test_synthesize(spark):
    c = spark.createDataFrame(
        [candidate(0, "pdfinfo", "Waves in tropical wood", [], "", "", 15), candidate(1, "grobid", "Waves in tropical wood", ["Ann Reed (ed.)"], "2011", "", 12), candidate(2, "llm:m", "", ["Bo Stone"], "", "10.1/b", 30)], CANDIDATE
    )
    got = cands.synthesize(cands.prepared(c)).first()
    assert (got.title, got.authors, got.year, got.doi, got.priority) == ("Waves in tropical wood", ["Bo Stone"], "2011", "10.1/b", 12)


def test_best_identifier_is_order_free(spark):
    shape = "doc_id long, kind string, pos int, value string, sanity_score double, sanity_passed boolean"
    rows = [(1, "isbn", 0, "i", 0.9, True), (1, "doi", 1, "b", 0.5, True), (1, "doi", 0, "a", 0.3, False), (2, "doi", 0, "x", 0.1, False), (2, "arxiv", 0, "y", 0.3, False)]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.value for r in lookup.best_identifier_match(spark.createDataFrame(order, shape)).collect()}
        assert got == {1: "b", 2: "y"}


def test_blocking_counts_stop_words(spark):
    """Word Jaccard counts all words, so a title without the rarest of ten is a pair."""
    from citeweave.operators import search

    query = spark.createDataFrame([(1, "on the use of a norm in spaces with zorblax"), (2, "a linear algebra")], "qid long, title string")
    catalog = spark.createDataFrame([(1, "on the use of a norm in spaces with"), (2, "zorblax"), (20, "linear algebra"), *((k, f"norm use spaces {k}") for k in range(3, 9))], "eid long, title string")
    assert {(1, 1), (2, 20)} <= {tuple(r) for r in search.blocked_pairs(query, catalog).collect()}


def test_three_decimals_by_binary_value(spark):
    """Ties of the decimal text are none of the number: as Python prints it."""
    from citeweave.sources.files import three_decimals

    scores = [0.2975, 0.0625, 0.1875, 0.0005, 0.0015, 0.1235, 0.4115, 0.5, 1.0, 0.0, 0.9995, -0.0625, 12.3455, 0.123, 0.1229999999999999, 3.0e9] + [(2 * n + 1) / 2000 for n in range(1000)]
    df = spark.createDataFrame([(n, s) for n, s in enumerate(scores)], "n int, s double")
    assert [r[0] for r in df.orderBy("n").select(three_decimals(F.col("s"))).collect()] == [f"{s:.3f}" for s in scores]


def test_replies_and_texts_are_searched_once(spark):
    """A path of a TEI reply is looked up once a row, be its result named in filters; a round of repair searches a text twice, not four times."""
    from citeweave.sources import catalogs as cat

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    replies = spark.createDataFrame([(1, "<a/>")], "doc_id long, payload string")
    assert plan(cat.candidates_from_tei(replies)).count("//titleStmt/title[1]/text()") == 1
    texts = spark.createDataFrame([("a",)], "t string")
    assert plan(texts.select(repair.repair_title_ligatures(F.col("t")).alias("x"))).count(repair.FRAGMENT) <= 2


def test_repair_ends_after_a_round_that_changes_nothing(spark):
    """All rounds that join something are made: each joins one more fragment of a chain."""
    t = "C Hapter and F Ield of thi Nki Ngab Outit Al and the End"
    want = tx_rounds(t)
    assert apply(spark, repair.repair_title_ligatures, [t, "plain words"]) == [want, "plain words"]


def tx_rounds(t):
    t = re.sub(r"(?<=\b[B-HJ-Z])\s+([A-Z])(?=[a-z]+\b)", lambda m: m[1].lower(), t)
    for _ in range(repair.ROUNDS):
        t = re.sub(repair.FRAGMENT, lambda m: m[0] if m[1].lower() in repair.STAY_APART else m[1] + m[2][0].lower() + m[2][1:], t)
    return t
