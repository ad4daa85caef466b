"""Near-duplicate join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Copies (equal tokens) collapse to one representative with a count.
2. Each representative has ``N_HASH`` MinHash values of 16 bits; ``BANDS`` longs of ``ROWS`` of them deal it to buckets.
3. Bayesian pruning: the members of a bucket compare their MinHash values ``STEP`` at a time. After n values with m
   equal, the similarity has a Beta(m+1, n-m+1) posterior; a pair whose chance of reaching the threshold is under ``TOLERANCE``
   drops out. The survivors join members of a bucket in a forest, a row a member at most.
4. Components of these forests hold every surviving pair. Each component's texts come together once and its pairs, pruned
   in the same way, are verified exactly on their whole shingle sets. A representative's links are added up, weighted with
   the copies, and verified pairs leave forest edges, whose components are the classes.

No pair is a row: buckets and components of more than ``SIDE`` members, or more than ``SIDE_CHARS`` characters of text where texts come along, are dealt as
pairs of blocks of so many, each a task of its own, and what leaves a task is a row a member. Similarity decides alone; there is no cap on members or partners.

A text of fewer than five tokens has one shingle, all of them. Null, empty and token-less texts have none and are linked to
nothing. Rows repeated whole are copies of each other. A missing doc_id is a document like any other; class_id is the least
doc_id of its class (null where all its ids are null). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ROW, connected, let_go, partitions, row_key, stash

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
N_HASH = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-4
SIDE, SIDE_CHARS = 1024, 16_000_000
_TOKEN = re.compile(r"\w+")
_RANDOM = np.random.default_rng(5)
_A = _RANDOM.integers(1, 2**32, N_HASH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, N_HASH, dtype=np.uint64).astype(np.uint32)
_MIX = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_WORDS: dict[str, int] = {}
_WORDS_MOST = 300_000


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five tokens."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > _WORDS_MOST:
        _WORDS.clear()
    ids = np.empty(len(words), np.uint64)
    get = _WORDS.get
    own = [get(w) for w in words]
    for i, x in enumerate(own):
        if x is None:
            own[i] = _WORDS[words[i]] = xxh3_64_intdigest(words[i].encode())
    ids[:] = own
    n = max(len(ids) - SHINGLE + 1, 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        h += (ids[k : k + n] ^ (ids[k : k + n] >> np.uint64(31))) * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(29)))


def minhash(s: np.ndarray) -> np.ndarray:
    """``N_HASH`` least values of a set, their low 16 bits, as ``BANDS`` longs."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASH, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(out, (low[i : i + 256, None] * _A + _B).min(0), out=out)
    return out.astype(np.uint16).view(np.int64)


@lru_cache
def fewest_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): of the first n values at least m must be equal for a posterior chance of ``tolerance`` or more.

    P(s >= t | m of n) under a uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, N_HASH + 1, STEP):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def pruned(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of two signature blocks those that pruning leaves; ``done`` first values were compared."""
    for n, m in fewest_equal():
        if n > done and len(i):
            ok = (a[i, :n] == b[j, :n]).sum(1) >= m
            i, j = i[ok], j[ok]
    return i, j


def survivors(a: np.ndarray, b: np.ndarray, same_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that pruning leaves; i < j where the blocks are one."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    n, m = fewest_equal()[0]
    for x in range(len(a)):
        y0 = x + 1 if same_block else 0
        y = np.flatnonzero((b[y0:, :n] == a[x, :n]).sum(1) >= m) + y0
        i, j = pruned(a, b, np.full(len(y), x), y, n)
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, least node of its tree) for every node of the edges a - b, roots left out."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent if find(x) != x]


def blocked(members: DataFrame, group: list[str], sizes: DataFrame) -> DataFrame:
    """(group, rep) → (group, rep, lo, hi, side): groups of at most ``SIDE`` are one task, larger ones a task for each pair of blocks.

    ``sizes`` may have ``chars``, the length of a group's texts. Blocks are cut by hash, so their number follows from the group's size alone and no group is sorted or gathered.
    """
    dealt = members.join(sizes.filter("size > 1"), group)
    by_text = f"(chars + {SIDE_CHARS} - 1) div {SIDE_CHARS}" if "chars" in sizes.columns else "1"
    dealt = dealt.withColumn("blocks", F.expr(f"cast(greatest(1, least(size, greatest((size + {SIDE} - 1) div {SIDE}, {by_text}))) as int)"))
    dealt = dealt.withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    # block x meets every block y: as the left side for y >= x, as the right side for y < x
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side")))
    many = F.expr("transform(sequence(0, blocks - 1), y -> struct(least(block, y) as lo, greatest(block, y) as hi, cast(block > y as int) as side))")
    return dealt.select(*group, "rep", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)).alias("at")).select(*group, "rep", "at.*")


def in_tasks(dealt: DataFrame, group: list[str], work, schema: str) -> DataFrame:
    """Tasks' rows brought together and sorted; ``work`` gets an Arrow table of whole tasks and where each begins and ends."""
    by = [*group, "lo", "hi"]
    ready = dealt.repartition(partitions(dealt.sparkSession), *by).sortWithinPartitions(*by, "side", "rep")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            edge = edges(table)
            if len(edge) > 2:  # the last task may go on in the next batch
                yield from work(table.slice(0, edge[-2]), edge[:-1])
                held = table.slice(edge[-2])
            else:
                held = table
        if held is not None and held.num_rows:
            yield from work(held, edges(held))
        let_go(_WORDS)

    def edges(table: pa.Table) -> np.ndarray:
        differ = np.zeros(max(table.num_rows - 1, 0), bool)
        for c in by:
            v = table.column(c).to_numpy()
            differ |= v[1:] != v[:-1]
        return np.concatenate([[0], np.flatnonzero(differ) + 1, [table.num_rows]])

    return ready.mapInArrow(stream, schema)


def signatures(table: pa.Table) -> np.ndarray:
    flat = table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(table.num_rows, N_HASH)


def _prune(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Forest edges of the surviving pairs of many tasks; tasks of few rows are compared side by side."""
    sig, rep, side = signatures(table), table.column("rep").to_numpy(), table.column("side").to_numpy()
    size = np.diff(edge)
    task = np.repeat(np.arange(len(size)), size)
    found = []
    small = size <= 32
    for d in range(1, int(size[small].max(initial=0))):
        i = np.flatnonzero((task[:-d] == task[d:]) & small[task[:-d]])
        found.append(pruned(sig, sig, i, i + d))
    for k in np.flatnonzero(~small).tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        m = a + int((side[a:b] == 0).sum())
        i, j = survivors(sig[a:m], sig[a:m] if m == b else sig[m:b], m == b)
        found.append((i + a, j + (a if m == b else m)))
    i, j = (np.concatenate([f[x] for f in found]) if found else np.empty(0, np.int64) for x in (0, 1))
    pairs = np.unique(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], 1), axis=0)
    out = forest(pairs[:, 0], pairs[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def shared(sets: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of sets[i] and sets[j].

    Many pairs of few sets become products of 0/1 rows over the shingles that two sets have at least, in slices of columns.
    """
    if len(i) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], float)
    rows = np.array(sorted(sets))
    _, inverse, count = np.unique(np.concatenate([sets[x] for x in rows.tolist()]), return_inverse=True, return_counts=True)
    column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
    owner = np.repeat(np.arange(len(rows)), [len(sets[x]) for x in rows.tolist()])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left, right = np.searchsorted(rows, np.unique(i)), np.searchsorted(rows, np.unique(j))
    width = max(64, 10_000_000 // len(rows))
    product = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, (c, c + width))
        m = np.zeros((len(rows), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        product += m[left] @ m[right].T
    return product[np.searchsorted(rows[left], i), np.searchsorted(rows[right], j)].astype(float)


def _verify(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(rep, root, links) of each task: the copies that a representative's verified neighbours stand for, and a forest edge."""
    sig, rep, side, copies = signatures(table), table.column("rep").to_numpy(), table.column("side").to_numpy(), table.column("copies").to_numpy()
    text = table.column("text")
    out: list[tuple[int, int, int]] = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        m = a + int((side[a:b] == 0).sum())
        whole = m == b
        i, j = survivors(sig[a:m], sig[a:m] if whole else sig[m:b], whole)
        i, j = i + a, j + (a if whole else m)
        sets = {k: shingles(tokens(text[k].as_py())) for k in np.unique(np.concatenate([i, j])).tolist()}
        both = shared(sets, i, j)
        size = np.zeros(table.num_rows)
        size[list(sets)] = [len(v) for v in sets.values()]
        ok = both >= THRESHOLD * (size[i] + size[j] - both) - 1e-9
        i, j = i[ok], j[ok]
        links = np.bincount(i - a, copies[j], b - a) + np.bincount(j - a, copies[i], b - a)
        root = dict(forest(rep[i], rep[j]))
        out += [(r, root.get(r, r), int(n)) for r, n in zip(rep[a:b].tolist(), links.tolist()) if n]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["rep", "root", "links"])


def _signed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, sig, chars): documents of equal tokens share ``key``, 128 bits; without tokens it is null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                keys, sigs = [], []
                for t in part.column(2).to_pylist():
                    words = tokens(t)
                    keys.append(xxh3_128_digest("\n".join(words).encode()) if words else None)
                    sigs.append(minhash(shingles(words)) if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), part.column(3)], names=["row", "doc_id", "key", "sig", "chars"]
                )
        let_go(_WORDS)

    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.length("text").cast("long").alias("chars"))
    return rows.mapInArrow(sign, f"row {ROW}, doc_id long, key binary, sig array<long>, chars long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_id, n_links, class_size, keeper): a row a document of ``docs``, repeated rows included.

    ``row`` is ``row_key()``; ``keeper`` marks the row that stands for its class: the least doc_id's.
    """
    signed = stash(_signed(docs), "near-sig")
    reps = stash(
        signed.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row")).alias("first"), F.first("sig").alias("sig"), F.max("chars").alias("chars"))
        .withColumn("rep", F.monotonically_increasing_id()),  # a short name for the key, fixed by being written
        "near-reps",
    )
    bucket = ["band", "value"]
    dealt = reps.select("rep", F.posexplode("sig").alias(*bucket))
    tasks = blocked(dealt, bucket, dealt.groupBy(*bucket).agg(F.count("*").alias("size")))
    edges = in_tasks(tasks.join(reps.select("rep", "sig"), "rep"), bucket, _prune, "a long, b long")
    parts = stash(connected(edges, "near-a").select(F.col("node").alias("rep"), F.col("root").alias("comp")), "near-parts")

    rows = parts.join(reps.select("rep", "copies", "sig", "first.row"), "rep")
    texts = docs.select(row_key().alias("row"), "text").join(rows.select("row", "rep", "sig", "copies"), "row").drop("row").dropDuplicates(["rep"])
    apart = blocked(parts, ["comp"], parts.join(reps.select("rep", "chars"), "rep").groupBy("comp").agg(F.count("*").alias("size"), F.sum("chars").alias("chars")))
    found = stash(in_tasks(apart.join(texts, "rep"), ["comp"], _verify, "rep long, root long, links long"), "near-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).filter("a <> b"), "near-b")

    known = reps.select("key", "rep", "copies", "first").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    classes = known.groupBy("root").agg(F.min("first").alias("least"), F.min("first.doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = stash(classes, "near-classes")  # a table of its own: the join's sides are plain exchanges, which Spark splits where a class is large
    of_rep = known.join(classes, "root").select("key", "class_id", "class_size", "least", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    every = signed.select("row", "doc_id", "key").join(of_rep, "key", "left")
    lone = F.col("key").isNull()
    return every.select(
        "row",
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (lone | (F.col("row") == F.col("least.row"))).alias("keeper"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class."""
    kept = near_duplicates(docs).filter("keeper").select(F.col("row").alias("__row")).distinct()
    stays = docs.withColumn("__row", row_key()).join(kept, "__row", "left_semi")
    return stays.dropDuplicates(["__row"]).select(*docs.columns)
