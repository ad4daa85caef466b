"""Token alignment, license templates and vector codes against brute force, and their edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.llm import op11_galloping_alignment as op11
from citeweave.llm import op12_license_templates as op12
from citeweave.llm import op13_value_dictionaries as op13
from citeweave.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", "é", " ", " ", "\n", "'s", ".", ",", "  ", "\t", "1", "-", "漢", "🙂", "\r\n", "\x1c", "<|endoftext|>", "<s>", "don't", "\n\n", "▁", "\x00", "<0x41>", "ing", "tion"]


@pytest.fixture(scope="module")
def words():
    return op11.Vocabularies(A, B)


def groups(text, words):
    """Groups as (A ids, B ids), by sets of ends of each tokenizer's own encoding of the whole text."""
    a, b = words.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text)
    ends = lambda ids, spelt: np.cumsum([len(spelt[i]) for i in ids]).tolist()
    if not text or b"".join(words.b_bytes[i] for i in b) != (" " + text).encode():
        return []
    of_a, of_b = ends(a, words.a_bytes), ends(b, words.b_bytes)
    out, i, j = [], 0, 0
    for end in sorted(set(of_a) & set(of_b)):
        to_a, to_b = of_a.index(end) + 1, of_b.index(end) + 1
        out.append((a[i:to_a], b[j:to_b]))
        i, j = to_a, to_b
    return out


def digests(texts, words):
    found = [groups(t or "", words) for t in texts]
    links = [Counter((x, y) for a, b in own for x in a for y in b) for own in found]
    docs = Counter(p for own in links for p in own)
    best: dict = {}
    for (a, _), n in docs.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for own, pairs in zip(found, links):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), sum(pairs.values()), sum(n for p, n in pairs.items() if docs[p] == best[p[0]]),
            sum(n * docs[p] for p, n in pairs.items()), hashlib.sha256(line.encode()).hexdigest() if own else "",
        ))
    return out


def digest_of(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_op11_gallop():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ends = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
        lo = rng.integers(0, len(ends), 40)
        want = rng.integers(0, 520, 40)
        assert op11.gallop(ends, lo, np.full(40, len(ends)), want).tolist() == [max(a, int(np.searchsorted(ends, w))) for a, w in zip(lo, want)]


def test_op11_against_sets(words):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    found = op11.Aligned(words, texts)
    want = digests(texts, words)
    assert list(zip(found.n_a, found.n_b, found.n_groups, found.n_links, found.written())) == [(w[0], w[1], w[2], w[3], w[6]) for w in want]


def test_op11_query(spark, sf, words):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: digest_of(r) for r in QUERIES["op11_galloping_alignment"](spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == digests([r.text for r in docs], words)


def test_op11_edges(spark, words, monkeypatch):
    texts = [None, "", " ", "  x", "same text", "same text", "▁ no way back", "ab" * 40_000, "word " * 20_000, "<|endoftext|> <s> plain"]
    rows = [(i if i != 2 else None, t, 1, "x", [1]) for i, t in enumerate(texts)] + [(4, "same text", 1, "x", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, pair string, times array<int>")
    want = Counter(digests([r[1] for r in rows], words))
    assert Counter(map(digest_of, op11.token_links(df, A, B).collect())) == want
    monkeypatch.setattr(op11.meet, "__defaults__", (0,))  # counts met in a shuffle
    assert Counter(map(digest_of, op11.token_links(df, A, B).collect())) == want
    assert op11.token_links(df.limit(0), A, B).count() == 0


def test_op11_wide_groups_and_ranges(spark, words, monkeypatch):
    texts = ["plain words here", "漢字🙂漢字🙂 and " * 30]
    want = digests(texts, words)
    monkeypatch.setattr(op11, "WIDE", 1)
    monkeypatch.setattr(op11, "PAIRS_AT_ONCE", 4)
    text, pair, times = op11.Aligned(words, texts).pairs()
    assert [int(times[text == i].sum()) for i in (0, 1)] == [w[3] for w in want] and len(set(zip(text.tolist(), pair.tolist()))) == len(pair)
    got = op11.alignments(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        cuts = list(zip([0, *r.a_cuts], r.a_cuts, [0, *r.b_cuts], r.b_cuts))
        assert [(r.a_ids[a:b], r.b_ids[c:d]) for a, b, c, d in cuts] == groups(t, words)


def accepts(tree, words, at):
    """Ends (exclusive) of stretches from ``at`` that the tree accepts, by trying every way."""
    if not tree:
        return {at}
    head, rest = tree[0], tree[1:]
    if isinstance(head, bytes):
        return accepts(rest, words, at + 1) if at < len(words) and words[at] == head else set()
    if head[0] == "opt":
        return accepts(rest, words, at) | accepts([*head[1], *rest], words, at)
    import re

    ends = set()
    for n in range(head[2] + 1):
        if n >= head[1]:
            ends |= accepts(rest, words, at + n)
        if at + n >= len(words) or not re.fullmatch(head[3].encode(), words[at + n]):
            break
    return ends


TEMPLATES = [
    ("x", "a <<beginOptional>> b <<beginOptional>> c <<endOptional>> <<endOptional>> d <<var;name='n';words='0-2'>> e"),
    ("y", "<<var;name='n';words='1-2';match='[0-9]+'>> a b"), ("z", "c d <<beginOptional>> e <<endOptional>>"), ("z", "a <<var;name='n';words='2-3'>>"),
]


def test_op12_automaton_against_every_way():
    machine, rng = op12.Automaton(TEMPLATES), random.Random(2)
    for _ in range(3000):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"1", b"q"]) for _ in range(rng.randint(0, 14))]
        got = machine.marks(words, b" " + b" ".join(words) + b" ")
        every = {(label, i, end - 1) for label, t in TEMPLATES for i in range(len(words)) for end in accepts(op12.parse(t), words, i)}
        assert {g[0] for g in got} == {e[0] for e in every} and set(got) <= every
        ends = {(g[0], g[2]) for g in got}  # of one end the earliest start, of one start the longest
        assert all(any(s <= i and (label, to) in ends for label2, s, to in got if label2 == label and to >= end) for label, i, end in every)


@pytest.mark.parametrize("bad", ["<<beginOptional>> a", "a <<endOptional>>", "a <<var;name='x'>>", "<<var;words='1-2'>>", "a <<var;words='3-2'>>"])
def test_op12_bad_templates(bad):
    with pytest.raises(ValueError):
        op12.parse(bad)


def test_op12_notices(spark):
    texts = {
        "This work is licensed under the GNU General Public License, version 3.": ("gpl", "gpl,gpl-3.0", 1.0, 6, 6),
        "see the gnu general public license": ("gpl", "gpl", 0.5, 2, 2),
        "Released under the MIT-License. CC-BY 4.0": ("cc-by,mit", "cc-by,mit", 1.0, 3, 5),
        "Licensed under CC BY-NC 4.0": ("cc-by", "cc-by,cc-by-nc", 1.0, 2, 2),
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": ("apache", "apache,apache-2.0", 1.0, 3, 3),
        "PERMISSION IS HEREBY GRANTED to nobody": ("", "", 0.0, None, None),
        "Copyright (c) 2020 Some One. All rights reserved.": ("", "all-rights-reserved", 1.0, None, None),
        "émit license ccé by": ("", "", 0.0, None, None),
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.doc_id: (r.base_labels, r.labels, r.score, r.first_word, r.last_word) for r in op12.license_labels(df).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    spans = {r.doc_id: [tuple(m) for m in r.marks] for r in op12.license_marks(df).collect()}
    assert spans[0] == [("gpl-3.0", 0, 11)] and spans[4] == [("apache-2.0", 0, 21)]


def test_op12_edges(spark):
    long = "licensed under the " * 50_000 + "Apache License, Version 2.0"
    df = spark.createDataFrame([(1, None), (2, ""), (None, "!?"), (3, "mit license " * 5), (3, "mit license " * 5), (4, long)], "doc_id long, text string").withColumn("labels", F.lit("x"))
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in op12.license_labels(df).collect()), key=str)
    assert got == [(0, 0, 0, None, None, ""), (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (3, 10, 5, 0, 8, "mit"), (3, 10, 5, 0, 8, "mit"), (4, 150_005, 1, 150_000, 150_000, "apache,apache-2.0")]
    assert op12.license_labels(df.limit(0)).count() == 0


def codes(rows, rounds=op13.ROUNDS):
    """(vec_id, code, error) of kept rows in order, and the codebooks, in plain Python numbers."""
    kept = sorted(((i, [int(np.floor(256 * float(v))) for v in x]) for i, x in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // op13.PARTS
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[part(x, p) for _, x in kept[: op13.ENTRIES]] for p in range(op13.PARTS)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held: dict = {}
            for _, x in kept:
                held.setdefault(near(part(x, p), book)[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(book)]
    out = []
    for i, x in kept:
        best = [near(part(x, p), books[p]) for p in range(op13.PARTS)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def test_op13_against_plain_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.2, 32).astype(np.float32).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(300)]
    rows += [(301, None, 1), (302, [0.0] * 31 + [None], 1), (303, [float("nan")] + [0.0] * 31, 1), (304, [float("inf")] + [0.0] * 31, 1), (305, [], 1), (306, [0.0] * 16, 1), (None, rows[0][1], None), (7, rows[1][1], next(of for i, _, of in rows if i == 7))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("x", F.lit(1))
    whole = [(i, x) for i, x, _ in rows if x and len(x) == 32 and all(v is not None and np.isfinite(v) for v in x)]
    want, books = codes(whole)
    got = op13.vector_codes(df.repartition(5)).collect()
    assert Counter((r.vec_id, r.code, r.error) for r in got) == Counter(want)
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {sha}
    of = {i: label for i, _, label in rows}
    total = Counter()
    for r in got:
        total[of[r.vec_id]] += r.error
    assert all(r.label_error == total[of[r.vec_id]] for r in got) and len(total) == 4
    packed, trained = op13.trained(df)
    back = op13.decoded(op13.encoded(packed, trained), trained).collect()
    asked = {i: [int(np.floor(256 * float(v))) for v in x] for i, x in whole if i not in (None, 7)}
    assert all(sum((a - b) ** 2 for a, b in zip(r.x, asked[r.vec_id])) == r.error for r in back if r.vec_id in asked)


def test_op13_edges(spark, monkeypatch):
    shape = "vec_id long, embedding array<float>, label int"
    few = [(i, [0.1 * i] * 16, 0) for i in range(3)] + [(2, [0.2] * 16, 0), (9, [3e38] * 16, 0), (10, [-3e38] * 16, None)]
    got = op13.vector_codes(spark.createDataFrame(few, shape)).collect()
    assert len(got) == 6 and all(r.error == 0 for r in got) and {r.label_error for r in got} == {0}
    assert op13.vector_codes(spark.createDataFrame([(1, [0.5] * 17, 0)], shape)).count() == 0
    assert op13.vector_codes(spark.createDataFrame([], shape)).count() == 0
    monkeypatch.setattr(op13.meet, "__defaults__", (0,))  # label sums met in a shuffle
    assert op13.vector_codes(spark.createDataFrame(few, shape)).count() == 6


def test_op13_blocks_decode():
    x = np.random.default_rng(1).integers(-300, 300, (50, 8))
    block = op13.Block.of(x)
    assert (block.vectors() == x).all()
    books = np.random.default_rng(2).integers(-300, 300, (2, 5, 4))
    nearest, error = block.assign(books)
    far = ((x.reshape(50, 2, 1, 4) - books[None]) ** 2).sum(-1)
    assert (nearest == far.argmin(2)).all() and (error == far.min(2)).all()
