"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over ``SPAN`` tokens; tokens at its gaps are ignored, so a replaced word spoils only windows that
select it. Hashes of all masked windows of the benchmark and of a document are joined; every hit gives a pair and a diagonal,
and along the diagonal the longest stretch with a share of ``SIMILAR`` equal tokens is verified: at least ``LEAST`` tokens (or
the whole item if it is shorter), replaced ones at its ends included; what is reported is cut to its equal ends. Items of
fewer than ``SPAN`` tokens have masks of their own, two of so many blocks that two stay whole under all replacements
that the share allows; items of fewer than five tokens match whole and unchanged. ``shortest`` leaves shorter items out (none by default).

Tokens are lower-case runs of letters, digits and underscores. A benchmark of ``BLOCK_TOKENS`` tokens at most goes to the tasks whole: one pass
over the documents, nothing shuffled. A larger one stays in Spark: its hashes are a table, a map of bits of bounded size tells
which hashes of a document can meet it, those are joined with the table, and pairs that meet get both texts and are verified in tasks.

Null and empty texts, and missing items, match nothing; repeated rows each report; other columns, whatever their names, are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import let_go, stash

# The masks; 1 selects a token.
MASKS = ("110100010011", "101011001001", "111001000101", "100110110010")
SPAN = 12
LEAST, SIMILAR, SHORTEST = 13, 0.8, 1
BLOCK_TOKENS = 1_000_000
_TABLE_BITS = 22
#: Bits of the map of a large benchmark's hashes: 2 ** this, at most.
MAP_BITS = 27
_TOKEN = re.compile(r"\w+")
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def masked(ids: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the selected tokens of each window; a window starts at each place where its last token exists."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        total += ids[o : o + n] * _FACTORS[k]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0x9E3779B97F4A7C15)


def short_masks(n: int) -> list[list[int]]:
    """Masks for items of ``n`` tokens: whatever tokens are replaced, up to a share of 1 - ``SIMILAR``, one mask misses all of them."""
    replaced = int(n * (1 - SIMILAR) + 1e-9)
    return [np.concatenate(two).tolist() for two in combinations(np.array_split(np.arange(n), replaced + 2), 2)]


def mask_list(lengths: set[int]) -> list[tuple[list[int], Callable[[int], bool]]]:
    """Offsets of each mask, and which lengths of items it is for."""
    spaced = [([i for i, c in enumerate(m) if c == "1"], lambda n: n >= SPAN) for m in MASKS]
    return spaced + [(o, lambda n, s=s: n == s) for s in sorted(lengths) if s < SPAN for o in short_masks(s)]


def longest(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch with ``SIMILAR`` equal tokens or more, as a half-open range; the first of several."""
    total = np.concatenate([[0], np.cumsum(np.where(same, round(100 * (1 - SIMILAR)), -round(100 * SIMILAR)))])
    low = np.minimum.accumulate(total)
    # for each end the earliest start whose sum is not above the end's
    start = np.searchsorted(-low, -total, "left")
    k = int((np.arange(len(total)) - start).argmax())
    return int(start[k]), k


#: Places of one hash in a text times those in the benchmark; above, their differences are taken stretch by stretch.
HEAVY = 256


def stretches(at: np.ndarray) -> list[tuple[int, int, int]]:
    """Ascending numbers as (first, step, count) of even steps; a lone one has step 0."""
    out, i, n, gaps = [], 0, len(at), np.diff(at)
    turns = np.append(np.flatnonzero(np.diff(gaps)) + 1, len(gaps))  # gaps are alike from one turn to the next
    while i < n:
        if i == n - 1:
            out.append((int(at[i]), 0, 1))
            break
        j = int(turns[np.searchsorted(turns, i, "right")])
        out.append((int(at[i]), int(gaps[i]), j - i + 1))
        i = j + 1
    return out


def diagonals(places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Distinct differences of two ascending lists. Of two stretches of one step, n and m long, there are n + m - 1, whatever n m is."""
    p, q = stretches(places), stretches(seeds)
    found = []
    if 4 * len(p) * len(q) > len(places) * len(seeds):  # no even steps: all differences, a bounded number at once
        rows = max(1, 1_000_000 // len(seeds))
        return np.unique(np.concatenate([np.unique(places[i : i + rows, None] - seeds[None, :]) for i in range(0, len(places), rows)]))
    for a, s, n in p:
        for b, t, m in q:
            if n == 1 or m == 1 or s == t:
                step = s or t or 1
                found.append(np.arange(a - b - (m - 1) * t, a - b + (n - 1) * s + 1, step))
            else:
                short, long = ((a - b + s * np.arange(n), -t * np.arange(m)) if n < m else (a - b - t * np.arange(m), s * np.arange(n)))
                found += [x + long for x in short.tolist()]
    return np.unique(np.concatenate(found))


class Seeds:
    """A block of the benchmark: its vocabulary, and for each mask its hashes in order with item and position."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = SHORTEST):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            own = [self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)]
            if len(own) >= max(shortest, 1):
                self.items.append((item_id, np.array(own, np.uint64)))
        self.masks = []
        for offsets, fits in mask_list({len(x) for _, x in self.items}):
            found = [(masked(x, offsets), k) for k, (_, x) in enumerate(self.items) if fits(len(x))]
            if not found:
                continue
            h = np.concatenate([a for a, _ in found])
            which = np.concatenate([np.full(len(a), k) for a, k in found])
            at = np.concatenate([np.arange(len(a)) for a, _ in found])
            order = np.argsort(h, kind="stable")
            known = np.zeros(1 << _TABLE_BITS, bool)
            known[h >> np.uint64(64 - _TABLE_BITS)] = True
            self.masks.append((offsets, known, h[order], which[order], at[order]))

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) of one run of tokens."""
        found = []
        for offsets, known, h, which, at in self.masks:
            own = masked(ids, offsets)
            place = np.flatnonzero(known[own >> np.uint64(64 - _TABLE_BITS)])
            if len(place):
                low, high = (np.searchsorted(h, own[place], side) for side in ("left", "right"))
                order = np.argsort(low, kind="stable")
                place, low, high = place[order], low[order], high[order]
                first = np.flatnonzero(np.diff(low, prepend=-1) | (high == low))
                times = np.diff(np.append(first, len(low)))
                heavy = times * (high - low)[first] > HEAVY
                for i, n in zip(first[heavy].tolist(), times[heavy].tolist()):  # text and benchmark repeat this hash
                    items, seeds = which[low[i] : high[i]], at[low[i] : high[i]]
                    for k in np.unique(items):
                        found.append(np.stack(np.broadcast_arrays(k, diagonals(place[i : i + n], np.sort(seeds[items == k]))), 1))
                light = ~np.repeat(heavy, times)
                place, low, high = place[light], low[light], high[light]
                n = high - low
                row = np.repeat(np.arange(len(place)), n)
                seed = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                found.append(np.stack([which[seed], place[row] - at[seed]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def verified(item: np.ndarray, ids: np.ndarray, begin: int, end: int, diagonal: int) -> tuple[int, int, int, int] | None:
    """(start in the item, start in the tokens, length, equal) of the best stretch on a diagonal inside [begin, end)."""
    a, b = max(0, begin - diagonal), min(len(item), end - diagonal)
    if b <= a:
        return None
    same = item[a:b] == ids[diagonal + a : diagonal + b]
    start, stop = longest(same)
    if stop - start < min(LEAST, len(item)):
        return None
    ends = np.flatnonzero(same[start:stop])
    start, stop, equal = start + int(ends[0]), start + int(ends[-1]) + 1, len(ends)
    length = stop - start
    return a + start, diagonal + a + start, length, equal


def best_of(item: np.ndarray, ids: np.ndarray, begin: int, end: int, along: list[int]) -> tuple[int, int, int, int] | None:
    """The best of ``verified`` over diagonals: most equal tokens, then the earliest start. One that can't beat the best so far isn't looked at."""
    rows = np.array(along, np.int64)
    start = np.maximum(begin, rows)
    room = np.minimum(rows + len(item), end) - start
    best = None
    for k in np.lexsort((rows, -room)).tolist():
        if best and (room[k] < best[3] or (room[k] == best[3] and start[k] >= best[1])):
            continue
        found = verified(item, ids, begin, end, int(rows[k]))
        if found and (best is None or (found[3], -found[1]) > (best[3], -best[1])):
            best = found
    return best


def overlaps_of(seeds: Seeds, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item id, start in the item, start in the text, length, equal tokens): the best of each pair."""
    get = seeds.vocabulary.get
    gap = [0] * SPAN
    flat: list[int] = []
    begins, ends = [], []
    for t in texts:
        begins.append(len(flat))
        flat.extend([get(w, 0) for w in tokens(t)])
        ends.append(len(flat))
        flat.extend(gap)
    ids = np.array(flat, np.uint64)
    edges = np.array(begins)
    pairs: dict[tuple[int, int], list[int]] = {}
    for k, diagonal in seeds.hits(ids).tolist():
        # a diagonal may start before the text that it hits, by less than the item's length
        for d in range(int(np.searchsorted(edges, diagonal, "right")) - 1, len(edges)):
            if d < 0:
                continue
            if begins[d] >= diagonal + len(seeds.items[k][1]):
                break
            pairs.setdefault((d, k), []).append(diagonal)
    best = {}
    for (d, k), along in pairs.items():
        found = best_of(seeds.items[k][1], ids, begins[d], ends[d], along)
        if found:
            best[d, k] = found
    for (d, k), (i, t, length, equal) in sorted(best.items()):
        yield d, seeds.items[k][0], i, t - begins[d], length, equal


FOUND = ("item_start", "doc_start", "n_tokens", "n_equal")


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document and benchmark item that it holds: (doc_id, item_id, item_start, doc_start, n_tokens, n_equal)."""
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 4 * block_tokens:
        return _joined(docs, rows, shortest)
    kind = docs.schema["doc_id"].dataType.simpleString()
    block = [tuple(r) for r in rows.collect()]
    made: list[Seeds] = []

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Seeds(block, shortest))
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                ids = batch.column(0).slice(i, 500)
                found = list(overlaps_of(made[0], batch.column(1).slice(i, 500).to_pylist()))
                columns = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "item_id", *FOUND]
                )
        let_go()

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id long, item_start long, doc_start long, n_tokens long, n_equal long")


def word_ids(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w.encode()) for w in words], np.uint64)


def folded(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending places as stretches: (hash, first, step, count)."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    few = np.repeat(times < 3, times)
    out = [(h[few], at[few], np.zeros(few.sum(), np.int64), np.ones(few.sum(), np.int64))]
    for i, n in zip(first[times >= 3].tolist(), times[times >= 3].tolist()):
        rows = np.array(stretches(at[i : i + n]), np.int64)
        out.append((np.full(len(rows), h[i]), *rows.T))
    return tuple(np.concatenate(c) for c in zip(*out))


def _joined(docs: DataFrame, rows: DataFrame, shortest: int) -> DataFrame:
    """The same rows for a benchmark of any size, by joins on (mask, hash)."""
    # an item is known by the number that it gets when it is written; a document by two hashes of its row. Places of one hash in one text are
    # written as stretches of even steps, so that repeats of a text meet those of another as a few rows
    items = stash(rows.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    masks = mask_list(set(range(max(shortest, 1), SPAN)))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = word_ids(tokens(text))
                for m, (offsets, fits) in enumerate(masks):
                    if len(ids) >= max(shortest, 1) and fits(len(ids)):
                        h = masked(ids, offsets)
                        of, *held = folded(h, np.arange(len(h)))
                        out.append((np.full(len(of), m, np.int32), of.view(np.int64), np.full(len(of), item), *held))
            columns = [np.concatenate(c) for c in zip(*out)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 5))], names=["mask", "hash", "item", "at", "at_step", "at_n"])

    table = stash(items.select("item", "text").mapInArrow(seeds, "mask int, hash long, item long, at long, at_step long, at_n long"), "seeds")
    used = [r[0] for r in table.select("mask").distinct().collect()]
    bits = min(MAP_BITS, max(16, (16 * max(table.count(), 1)).bit_length()))
    top = table.select(F.expr(f"shiftrightunsigned(hash, {64 - bits})").alias("t")).select(F.expr("shiftright(t, 6)").alias("cell"), F.expr("shiftleft(1L, cast(t % 64 as int))").alias("bit"))
    cells = top.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()
    known = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    for r in cells:
        known[r.cell] = r.bits & (2**64 - 1)
    known = docs.sparkSession.sparkContext.broadcast(known)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, out = batch.slice(i, 500), []
                for k, text in enumerate(part.column(2).to_pylist()):
                    ids = word_ids(tokens(text))
                    for m in used:
                        h = masked(ids, masks[m][0])
                        t = h >> np.uint64(64 - bits)
                        at = np.flatnonzero(cell[(t >> np.uint64(6)).astype(np.int64)] >> (t & np.uint64(63)) & np.uint64(1))
                        of, *held = folded(h[at], at)
                        out.append((np.full(len(of), k), np.full(len(of), m, np.int32), of.view(np.int64), *held))
                row, *columns = [np.concatenate(c) for c in zip(*out)] or [np.empty(0, np.int64)] * 6
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4)))],
                    names=["k1", "k2", "mask", "hash", "place", "place_step", "place_n"],
                )
        let_go()

    keyed = docs.filter("text <> ''").select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2"), "doc_id", "text")
    hits = keyed.select("k1", "k2", "text").mapInArrow(probe, "k1 long, k2 long, mask int, hash long, place long, place_step long, place_n long")
    met = hits.join(table, ["mask", "hash"]).select("k1", "k2", "item", "place", "place_step", "place_n", "at", "at_step", "at_n").distinct()
    # a row a pair: its stretches are no more than the tokens of both
    met = stash(met.groupBy("k1", "k2", "item").agg(F.collect_list(F.struct("place", "place_step", "place_n", "at", "at_step", "at_n")).alias("met")), "seed-hits")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (text, item, met) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                ids = word_ids(tokens(text))
                row = lambda x, c: x[c] + x[f"{c}_step"] * np.arange(x[f"{c}_n"])
                along = np.unique(np.concatenate([diagonals(row(x, "place"), row(x, "at")) for x in met]))
                found = best_of(word_ids(tokens(item)), ids, 0, len(ids), along)
                if found:
                    rows.append((k, *found))
            at, *columns = zip(*rows) if rows else [()] * 5
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=["k1", "k2", "item", *FOUND])
        let_go()

    hit = keyed.select("k1", "k2", "text").join(met.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    texts = met.join(items.select("item", F.col("text").alias("item_text")), "item").join(hit.dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    shape = "k1 long, k2 long, item long, item_start long, doc_start long, n_tokens long, n_equal long"
    good = texts.select("k1", "k2", "item", "text", "item_text", "met").mapInArrow(check, shape)
    best = good.groupBy("k1", "k2", "item").agg(F.max_by(F.struct(*FOUND), F.struct("n_equal", -F.col("doc_start"))).alias("f"))
    return keyed.select("k1", "k2", "doc_id").join(best, ["k1", "k2"]).join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "f.*")
