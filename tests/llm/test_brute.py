"""Operators against slow and plain versions of themselves on small rows."""

import re

import numpy as np
import pytest

from citeweave.llm import op1_order_minhash as op1
from citeweave.llm import op2_template_removal as op2
from citeweave.llm import op3_best_fit as op3
from citeweave.llm import op5_spaced_seeds as op5
from citeweave.llm import op8_language_rnn as op8
from citeweave.llm import op9_compression_quality as op9

IDS = "doc_id long, text string"


def _hash(*values):
    """Spark's xxhash64 of longs and strings."""
    from xxhash import xxh64_intdigest

    h = 42
    for v in values:
        h = xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True), h)
    return h


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def slow_kmers(text):
    """(hash, occurrence, place) of each k-mer."""
    tokens = [1, 2, 3, 4, *(_signed(_hash(t)) for t in re.findall(r"\S{1,8}", text)), 5, 6, 7, 8]
    seen, out = {}, []
    for i in range(len(tokens) - op1.K + 1):
        h = _hash(*tokens[i : i + op1.K]) & (2**op1.HASH_BITS - 1)
        seen[h] = seen.get(h, 0) + 1
        out.append((h, seen[h], i))
    return out


def slow_signature(text, numbered):
    """Order MinHash, k-mer by k-mer; ``numbered`` has the hash of each k-mer that occurs again, with its number."""
    kmers = sorted((numbered[h, n] if n > 1 else h, i) for h, n, i in slow_kmers(text))
    out, done = [], set()
    for j, (h, i) in enumerate(kmers):
        bucket = h >> (op1.HASH_BITS - op1.M_BITS)
        if bucket in done:
            continue
        done.add(bucket)
        pair = sorted([(i, h), *([(kmers[(j + 1) % len(kmers)][1], kmers[(j + 1) % len(kmers)][0])] if len(kmers) > 1 else [])])
        out.append(bucket << op1.TUPLE_BITS | _hash(*(h for _, h in pair)) & (2**op1.TUPLE_BITS - 1))
    return out


def test_op1_signature(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{rng.integers(many)}" for _ in range(n)) for many in (10**6, 30, 2) for n in (0, 1, 2, 3, 7, 30, 90, 300) for _ in range(3)] + ["a " * 200, "a b c d e " * 60]
    again = sorted({(h, n) for t in texts for h, n, _ in slow_kmers(t) if n > 1})
    # the number is an integer of 32 bits, which Spark hashes by a rule of its own: asked of it
    rows = spark.createDataFrame(again, "h long, n int").select("h", "n", op1.F.xxhash64("h", "n").alias("x")).collect()
    numbered = {(r.h, r.n): r.x & (2**op1.HASH_BITS - 1) for r in rows}
    got = {r.doc_id: list(r.s) for r in op1.with_signature(spark.createDataFrame(list(enumerate(texts)), IDS), "text", "s").collect()}
    assert len(again) > 500 and all(got[i] == slow_signature(t, numbered) for i, t in enumerate(texts))


def test_op1_order_counts_in_short_texts(spark):
    """Texts with the same k-mers in another order differ."""
    s = "s " * 9
    pairs = [f"{s}a {s}b {s}".strip(), f"{s}b {s}a {s}".strip()]
    sig = [r.f for r in op1.with_signature(spark.createDataFrame(list(enumerate(pairs)), IDS), "text", "s").orderBy("doc_id").select(op1.as_text(op1.F.col("s")).alias("f")).collect()]
    assert sig[0] != sig[1]


def test_op1_likeness_follows_edits(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for n in (2, 10, 40, 120):
        own = list(base)
        for p in rng.choice(200, n, replace=False):
            own[p] = f"x{n}y{p}"
        texts.append(" ".join(own))
    s = [set(r.s) for r in op1.with_signature(spark.createDataFrame(list(enumerate(texts)), IDS), "text", "s").orderBy("doc_id").collect()]
    near = [len(s[0] & x) for x in s[1:]]
    assert near == sorted(near, reverse=True) and near[0] > 0.7 * len(s[0]) and near[-1] < 0.1 * len(s[0])


def test_op1_large_ids_and_one_id(spark):
    """Ids that are hashes of 62 bits, negative ones and an id that a third of the rows share: no row without a next one."""
    rng = np.random.default_rng(5)
    ids = [int(x) for x in rng.integers(-(2**62), 2**62, 300)]
    texts = {i: f"text {k} " * int(rng.integers(0, 20)) for k, i in enumerate(ids)}
    got = {r.doc_id: r for r in op1.order_minhash(spark.createDataFrame(list(texts.items()), IDS)).collect()}
    import hashlib

    order = sorted(ids)
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, f = texts[i], len(texts[i]) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - f] + texts[nxt][:f]).encode()).hexdigest()
    shared = spark.createDataFrame([*texts.items(), *((None, f"own {k} words") for k in range(150))], IDS)
    out = op1.order_minhash(shared).collect()
    assert len(out) == 450 and all(r.edited_sha256 and r.near_next is not None and r.near_edited is not None for r in out)


def test_op2_tags():
    read = lambda h: op2.main_text(op2.read(h))
    assert read(f"<div data-x=\"a > {'y' * 9000}\">hello</div>") == "hello"
    assert read("<div title='a > b'>hello</div>") == "hello" and read("<div title = 'a \"> b' x=\"'>'\">hello</div>") == "hello"
    assert read("<p it's>one</p><p 'x>two</p>") == "one\ntwo" and read('<p x="never closed>three</p>') == "three"
    assert read("<article><p>x <math><mi>a</mi></math> y</p></article>") == "x\na\ny"


def test_op2_by_counting_alone(spark, sf, monkeypatch):
    """Without the lists of elements, roles and words, and without the rule that an article is all, counting leaves the same texts on hosts with enough pages."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    want = {r.page_id: r.text for r in op2.main_texts(pages).collect()}
    hosted = op2.with_host(pages).select("page_id", "host", "html").collect()
    known: dict = {}
    for r in op2.templates(op2.with_host(pages)).collect():
        known.setdefault(r.host, set()).add(r.hash)
    unrendered = frozenset("script style head title".split())
    for name, value in (("FURNITURE", unrendered), ("ROLES", frozenset()), ("WORDS", frozenset()), ("_HEAD_WORDS", frozenset())):
        monkeypatch.setattr(op2, name, value)
    of_host: dict = {}
    for r in hosted:
        of_host.setdefault(r.host, []).append(r)
    checked = without = 0
    for host, rows in of_host.items():
        for r in rows:
            if len({want[x.page_id] for x in rows}) < op2.PAGES or not r.html:
                continue
            # an article is a block like any other
            plain = re.sub(r"(</?)article\b", r"\1section", r.html)
            page = op2.read(plain)
            assert len(op2.main_text(page)) > len(want[r.page_id])
            checked += 1
            without += op2.main_text(page, frozenset(known.get(host, ()))) == want[r.page_id]
    assert checked > 100 and without >= 0.95 * checked


def test_op2_shared_paragraphs_stay(spark):
    """Articles that quote one passage keep it; a share bar inside them goes."""
    page = "<body><article><p>own text {0} of this page only {0}</p><p>a passage that all of them quote</p><div class='share-x'>Tell a friend</div></article></body>"
    df = spark.createDataFrame([(i, f"http://a.org/{i}", page.format(f"n{i}")) for i in range(9)], "page_id long, url string, html string")
    assert all(r.text == f"own text n{r.page_id} of this page only n{r.page_id}\na passage that all of them quote" for r in op2.main_texts(df).collect())


def slow_pack(lengths, sizes, overhead):
    """Best fit with joint choice of the size, by plain search."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    bins = []
    for p, k in enumerate(order):
        n = lengths[k]
        fit = [b for b in range(len(bins)) if bins[b][0] - sum(lengths[x] for x in bins[b][1]) >= n]
        if fit:
            b = min(fit, key=lambda b: (bins[b][0] - sum(lengths[x] for x in bins[b][1]), b))
            bins[b][1].append(k)
            continue

        def cost(size):
            room, held = size - n, n
            for x in order[p + 1 :]:
                if lengths[x] <= room:
                    room, held = room - lengths[x], held + lengths[x]
            return (size + overhead) / held, size

        bins.append((min((s for s in sizes if s >= n), key=cost), [k]))
    return [(min(s for s in sizes if s >= sum(lengths[x] for x in own)), own) for _, own in bins]


@pytest.mark.parametrize("seed", range(12))
def test_op3_is_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, (40, 65, 20)[seed % 3], 120)
    bins, offsets, sizes = op3.pack_lengths(lengths, (16, 32, 64), 3)
    want = slow_pack(lengths.tolist(), (16, 32, 64), 3)
    got = [(s, [k for k in np.argsort(-lengths, kind="stable").tolist() if bins[k] == b]) for b, s in enumerate(sizes)]
    assert got == [(s, own) for s, own in want]
    for _, own in want:
        assert [int(offsets[k]) for k in own] == np.cumsum([0, *lengths[own][:-1]]).tolist()


def test_op3_repeated_rows_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(op3, "SHARD_TOKENS", 500)
    docs = spark.createDataFrame([(None, "one text again")] * 900, IDS).repartition(6)
    out = op3.best_fit(docs)
    shards = {r.shard: r["count"] for r in out.groupBy("shard").count().collect()}
    assert sum(shards.values()) == 900 and max(shards.values()) < 400


def slow_overlap(item, doc):
    """Whether any diagonal has a stretch with four fifths equal tokens of ``LEAST`` or of the whole item."""
    need = min(op5.LEAST, len(item))
    for d in range(-len(item) + 1, len(doc)):
        same = [doc[d + k] == item[k] for k in range(len(item)) if 0 <= d + k < len(doc)]
        for a in range(len(same)):
            for b in range(a + need, len(same) + 1):
                if 5 * sum(same[a:b]) >= 4 * (b - a):
                    return True
    return False


def _leaks(seed):
    rng = np.random.default_rng(seed)
    items = {k: [f"i{k}w{j}" if n >= 5 else f"short{k}x{j}" for j in range(n)] for k, n in enumerate((1, 2, 3, 4, 5, 6, 9, 11, 12, 13, 16, 20, 24, 40))}
    docs = {}
    for i in range(120):
        words = [f"d{rng.integers(400)}" for _ in range(int(rng.integers(0, 60)))]
        k = int(rng.integers(len(items)))
        own = list(items[k])
        a, b = sorted(rng.integers(0, len(own) + 1, 2)) if rng.random() < 0.3 else (0, len(own))
        for p in rng.choice(len(own), int(rng.integers(0, len(own) // 4 + 1)), replace=False):
            own[p] = "other"
        docs[i] = words + own[a:b] + words[:5]
    return items, docs


@pytest.mark.parametrize("block_tokens", [1_000_000, 0])
def test_op5_against_all_diagonals(spark, block_tokens):
    """Both ways: items of under twelve tokens exactly, longer ones but for the few that no seed hits."""
    items, docs = _leaks(3)
    want = {(i, k) for i, doc in docs.items() for k, item in items.items() if slow_overlap(item, doc)}
    made = [spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], s) for x, s in ((docs, IDS), (items, "item_id long, text string"))]
    got = {(r.doc_id, r.item_id) for r in op5.overlaps(*made, block_tokens=block_tokens).collect()}
    assert got <= want and len(want) > 60
    assert all(len(items[k]) >= op5.SPAN for _, k in want - got) and len(want - got) <= 0.05 * len(want)


def test_op5_both_ways_are_one(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(20))
    one, two = (sorted(map(tuple, op5.overlaps(docs, items, block_tokens=n).collect())) for n in (1_000_000, 0))
    assert one == two and one
    assert op5.overlaps(docs.limit(0), items, block_tokens=0).count() == 0


def slow_network(w, window):
    """Log-probabilities of each language at each byte of a window, byte by byte."""
    h, n = op8.HIDDEN, len(window)
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d in "fb":
        state, states[d] = np.zeros(h), np.zeros((n, h))
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            state = states[d][t] = step(w, d, state, window[t], sig)
    a = np.concatenate([states["f"], states["b"]], 1) @ w["V"] + w["c"]
    return a - np.log(np.exp(a).sum(1, keepdims=True))


def step(w, d, state, byte, sig):
    h = op8.HIDDEN
    e, u = w[d + "E"][byte], state @ w[d + "U"]
    r, z = sig(e[:h] + u[:h]), sig(e[h : 2 * h] + u[h : 2 * h])
    return z * state + (1 - z) * np.tanh(e[2 * h :] + r * u[2 * h :])


def test_op8_network_is_plain():
    """Sums over windows are those of a byte-by-byte network; every byte is labelled once."""
    net = op8.fit({"en": [b"the cat sat on the mat and then it ran"] * 4, "fr": [b"le chat noir dort sur la chaise et puis"] * 4})
    w = {k: v.astype(np.float64) for k, v in net.weights.items()}
    long = "the mat and le chat noir " * 40
    for text in ("the cat dort  sur\nla mat", long):
        total, n = op8.pooled(net, [text])
        x, there, _ = op8.windows([text.encode()])
        want = sum(slow_network(w, x[:, j])[there[:, j]].sum(0) for j in range(x.shape[1]))
        assert n[0] == there.sum() == len(text.split() and " ".join(text.split()))
        assert np.allclose(total[0], want, rtol=0.01, atol=0.5)
    x, there, text = op8.windows([long.encode(), b"", b"ab"])
    assert there.sum() == len(long.strip()) + 2 and set(text) == {0, 2}
    assert bytes(x[:, 1][there[:, 1]]) == long.encode()[op8.SPAN - 2 * op8.EDGE :][: op8.SPAN - 2 * op8.EDGE]


def test_op8_letters(spark):
    net = op8.Network(["a"], {k: v for k, v in op8.fit({"a": [b"xy"]}).weights.items()})
    texts = ["½ ² Ⅷ ①", "12 !", "", None, "é", "漢", "x 1"]
    got = {r.doc_id: r.lang_pred for r in op8.with_language(spark.createDataFrame(list(enumerate(texts)), IDS), net).collect()}
    assert [got[i] for i in range(len(texts))] == ["a" if t and any(map(str.isalpha, t)) else "und" for t in texts]


def test_op9_differences_are_plain():
    """Sizes block by block, compressed one at a time."""
    import zstandard as z

    good, bad = (z.train_dictionary(2048, [f"{w} {i} {w * (i % 3)} words of {w}".encode() for i in range(400)]).as_bytes() for w in ("fine", "junk"))
    texts = ["fine 3 fine words of fine " * 90, "junk 4 junk words of junk", "", None, "é 漢 🙂 " * 700]
    got = op9.differences(texts, good, bad)
    for t, d in zip(texts, got):
        raw = (t or "").encode()
        size = {}
        for name, dictionary in (("good", good), ("bad", bad)):
            c = z.ZstdCompressor(level=op9.LEVEL, dict_data=z.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(c.compress(raw[a : a + op9.BLOCK])) for a in range(0, len(raw), op9.BLOCK))
        assert d == pytest.approx((size["bad"] - size["good"]) / max(len(raw), 1))


