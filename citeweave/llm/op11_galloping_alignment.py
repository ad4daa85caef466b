"""Alignment of two tokenizers' tokens over the same bytes.

Each text's tokens end at byte offsets, one ascending list a tokenizer. Galloping intersection finds the offsets where both have an
end: each end of the shorter list is looked for in the longer one from where the last stood, with steps that double until they pass
it and then halve. Blocks of ends of all texts of a batch do so side by side. Common ends cut the tokens into groups; the difference
of two neighbouring common ends' ranks is the range of tokens of a group, on either side.

Null and empty texts have no tokens, and neither have texts that one of the vocabularies can't spell back (`` `` + text must come out).
Rows that are repeated, by id or whole, count as documents of their own and keep their rows. Other columns, whatever their names, are
ignored. A very long text is encoded by itself; a group that one long run of bytes without a common end makes is reduced to its distinct ids
before its pairs are counted.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import let_go, meet, stash
from citeweave.llm.op4_binary_ids import Pieces, runs_of

#: So many ends of the shorter list are looked for one after the other; blocks of them side by side.
BLOCK = 64
#: So many bytes of text are aligned together, one text at least.
BATCH_BYTES = 2_000_000
#: So many pairs are held as rows of their own at once.
PAIRS_AT_ONCE = 1 << 21
#: A group of more pairs is reduced to its distinct ids first.
WIDE = 1 << 12


def gallop(ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each lane the first place in ``lo .. hi`` whose end is ``want`` or more (``hi`` if none is): doubling steps, then halves."""
    low, top = lo - 1, lo.copy()  # the end at low is below, that at top is not or isn't known yet
    live = np.flatnonzero(lo < hi)
    live = live[ends[lo[live]] < want[live]]
    low[live] = lo[live]
    step = 1
    while len(live):
        to = np.minimum(low[live] + step, hi[live])
        top[live] = to
        inside = to < hi[live]
        below = np.zeros(len(live), bool)
        below[inside] = ends[to[inside]] < want[live[inside]]
        live = live[below]
        low[live] = to[below]
        step *= 2
    live = np.flatnonzero(top - low > 1)
    while len(live):
        middle = (low[live] + top[live]) >> 1
        below = ends[middle] < want[live]
        low[live[below]] = middle[below]
        top[live[~below]] = middle[~below]
        live = live[top[live] - low[live] > 1]
    return top


def common_ends(short: np.ndarray, s0: np.ndarray, s1: np.ndarray, longer: np.ndarray, l0: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal ends in both lists; text i has the ends ``s0[i] .. s1[i]`` of one and ``l0[i] .. l1[i]`` of the other."""
    blocks = -(-(s1 - s0) // BLOCK)
    text = np.repeat(np.arange(len(s0)), blocks)
    begin = s0[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    end, last = np.minimum(begin + BLOCK, s1[text]), l1[text]
    at = l0[text]
    held = np.full(len(short), -1, np.int64)
    live = np.arange(len(begin))
    for k in range(BLOCK):
        live = live[begin[live] + k < end[live]]
        if not len(live):
            break
        place = begin[live] + k
        at[live] = gallop(longer, at[live], last[live], short[place])
        found = at[live] < last[live]
        found[found] = longer[at[live[found]]] == short[place[found]]
        held[place[found]] = at[live[found]]
    where = np.flatnonzero(held >= 0)
    return where, held[where]


class Vocabularies:
    """Both tokenizers, and what each of their ids spells."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Pieces(a_path)
        self.a.tokenizer.encode_special_tokens = True
        self.a.added = None if self.a.added is None else []  # the strings of added tokens are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_of_character()
        spelt = (self.a.tokenizer.id_to_token(i) or "" for i in range(len(self.a.spell)))
        self.a_bytes = [bytes(map(byte.get, t)) if all(c in byte for c in t) else t.encode() for t in spelt]
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in held], np.int64) for held in (self.a_bytes, self.b_bytes))
        self.shift = (len(self.b_bytes) - 1).bit_length()  # of an A id in a pair
        self.bits = self.shift + (len(self.a_bytes) - 1).bit_length()
        most = max(len(self.a_bytes), len(self.b_bytes))
        digits = [str(i).encode() for i in range(most)]
        self.n_digits = np.array([len(d) for d in digits])
        width = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(most, width)
        self.held = np.arange(width) <= np.arange(width)[:, None]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end and how many each has, by A and by B; none for texts that aren't spelt back."""
        a, n_a = self.a.encode(pa.array(["x " + t for t in texts], pa.large_string()).cast(pa.string()))  # the letter is a token of its own
        first = np.cumsum(n_a) - n_a
        a, n_a = np.delete(a, first).astype(np.int64), n_a - 1
        each = self.b.encode(texts, num_threads=1)
        n_b = np.array([len(x) for x in each], np.int64)
        b = np.fromiter((i for x in each for i in x), np.int64, int(n_b.sum()))
        asked = [b" " + t.encode() if t else b"" for t in texts]
        right = np.array([bool(t) for t in texts])
        whole = b"".join(asked)
        for ids, n, spelt in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            if b"".join(map(spelt.__getitem__, ids.tolist())) != whole or not right.all():
                ends = np.cumsum(n)
                for i in np.flatnonzero(right):
                    right[i] = b"".join(map(spelt.__getitem__, ids[ends[i] - n[i] : ends[i]].tolist())) == asked[i]
        return a[np.repeat(right, n_a)], n_a * right, b[np.repeat(right, n_b)], n_b * right


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints as its own character, the others in turn from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Aligned:
    """Groups of a batch of texts: text, first and last token (exclusive) on either side."""

    def __init__(self, words: Vocabularies, texts: list[str]):
        self.words = words
        self.a, self.n_a, self.b, self.n_b = words.encode(texts)
        a1, b1 = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a0, b0 = a1 - self.n_a, b1 - self.n_b
        a_ends, b_ends = np.cumsum(words.a_size[self.a]), np.cumsum(words.b_size[self.b])  # over the batch: both sides spell the same texts
        by_a = self.n_a <= self.n_b
        x, y = common_ends(a_ends, a0[by_a], a1[by_a], b_ends, b0[by_a], b1[by_a])
        v, u = common_ends(b_ends, b0[~by_a], b1[~by_a], a_ends, a0[~by_a], a1[~by_a])
        self.a_to, self.b_to = np.sort(np.concatenate([x, u])) + 1, np.sort(np.concatenate([y, v])) + 1
        self.a_from, self.b_from = (np.concatenate([[0], to[:-1]]) if len(to) else to for to in (self.a_to, self.b_to))
        self.text = np.searchsorted(a1, self.a_from, side="right")
        self.n_groups = np.bincount(self.text, minlength=len(texts))
        self.wide = (self.a_to - self.a_from) * (self.b_to - self.b_from)
        self.n_links = np.zeros(len(texts), np.int64)
        np.add.at(self.n_links, self.text, self.wide)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair (A id and B id in one number) and number of links of each distinct pair, by text and pair."""
        bits = self.words.bits
        held: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.flatnonzero(self.wide <= WIDE)
        cuts = np.searchsorted(np.cumsum(self.wide[small]), np.arange(PAIRS_AT_ONCE, self.wide[small].sum(), PAIRS_AT_ONCE))
        for own in np.split(small, cuts):
            many, each_b = self.wide[own], self.b_to[own] - self.b_from[own]
            group = np.repeat(np.arange(len(own)), many)
            place = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
            of_a, of_b = np.divmod(place, each_b[group])
            own = own[group]
            found = (self.text[own] << bits) | (self.a[self.a_from[own] + of_a] << self.words.shift) | self.b[self.b_from[own] + of_b]
            held.append(np.unique(found, return_counts=True))
        for g in np.flatnonzero(self.wide > WIDE):
            a, a_times = np.unique(self.a[self.a_from[g] : self.a_to[g]], return_counts=True)
            b, b_times = np.unique(self.b[self.b_from[g] : self.b_to[g]], return_counts=True)
            rows = max(1, PAIRS_AT_ONCE // len(b))
            for i in range(0, len(a), rows):
                found = (self.text[g] << bits) | (a[i : i + rows, None] << self.words.shift) | b[None, :]
                held.append((found.ravel(), (a_times[i : i + rows, None] * b_times[None, :]).ravel()))
        found, times = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        if len(held) > 1:
            order = np.argsort(found, kind="stable")
            found, times = found[order], times[order]
            first = np.flatnonzero(np.diff(found, prepend=-1))
            found, times = found[first], np.add.reduceat(times, first) if len(first) else times
        return found >> bits, found & ((1 << bits) - 1), times

    def written(self) -> list[str]:
        """SHA-256 of each text's groups written out, empty without tokens."""
        n = len(self.a) + len(self.b)
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        a_at = np.arange(len(self.a)) + np.repeat(self.b_from, self.a_to - self.a_from)
        b_at = np.arange(len(self.b)) + np.repeat(self.a_to, self.b_to - self.b_from)
        ids[a_at], ids[b_at] = self.a, self.b
        sign[a_at[self.a_to - 1]], sign[b_at[self.b_to - 1]] = ord("|"), ord(";")
        width = self.words.n_digits[ids]
        cells = self.words.digits[ids]
        cells[np.arange(n), width] = sign
        line = memoryview(cells[self.words.held[width]].tobytes())
        tokens = np.cumsum(self.n_a + self.n_b)
        ends = np.concatenate([[0], np.cumsum(width + 1)])[tokens].tolist()
        return [hashlib.sha256(line[i : j - 1]).hexdigest() if i < j else "" for i, j in zip([0, *ends[:-1]], ends)]


_WORDS: dict[tuple[str, str], Vocabularies] = {}


def batches_of(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.Array, Aligned]]:
    """Ids of documents (first column) and the alignment of their texts (second column), a bounded number of bytes at a time."""
    words = _WORDS.setdefault((a_path, b_path), None) or Vocabularies(a_path, b_path)
    _WORDS[a_path, b_path] = words
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for i, j in runs_of(texts, BATCH_BYTES):
            yield batch.column(0).slice(i, j - i), Aligned(words, texts.slice(i, j - i).to_pylist())
    words.a.forget()
    let_go()


def lists(values: np.ndarray, sizes: np.ndarray, of: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, of))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, a_ids, b_ids, and the tokens up to the end of each group on either side (a_cuts, b_cuts)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in batches_of(batches, a_path, b_path):
            a0, b0 = (np.cumsum(n) - n for n in (found.n_a, found.n_b))
            values = [
                ids, lists(found.a, found.n_a, pa.int32()), lists(found.b, found.n_b, pa.int32()),
                lists(found.a_to - a0[found.text], found.n_groups, pa.int32()), lists(found.b_to - b0[found.text], found.n_groups, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def linked(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """Per row: a number of its own, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs and how many links each has; and by how many bits a pair's A id is shifted."""
    words = Vocabularies(a_path, b_path)
    shift, of = words.shift, (pa.int32() if words.bits < 32 else pa.int64())

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for ids, found in batches_of(batches, a_path, b_path):
            n = len(ids)
            text, pair, times = found.pairs()
            size = np.bincount(text, minlength=n)
            values = [
                pa.array(np.arange(row, row + n)), ids, *(pa.array(x.astype(np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                pa.array(found.written(), pa.string()), lists(pair, size, of), lists(times, size, pa.int64()),
            ]
            row += n
            yield pa.RecordBatch.from_arrays(values, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times"])

    kind = "int" if words.bits < 32 else "long"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<{kind}>, times array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(link, schema), shift


def pair_counts(links: DataFrame, shift: int) -> DataFrame:
    """(pair, docs, best): how many rows hold each pair linked, and whether no pair of its A id is held by more."""
    counted = links.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    a = F.shiftright("pair", shift)
    return counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(a)))  # at most as many rows as B has ids


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    The pairs' counts are broadcast while they are few, and met in a shuffle, whose hot pairs Spark splits, where they are not.
    """
    found, shift = linked(docs, a_path, b_path)
    links = stash(found, "links")
    counts = stash(pair_counts(links, shift), "pair-counts")
    each = links.select("row", F.inline(F.arrays_zip("pair", "times")))
    sums = (
        meet(each, counts, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    )
    own = links.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
