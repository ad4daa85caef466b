"""Token ids in word-aligned binary files.

Each 64-bit word holds a 4-bit selector and as many ids as fit at the selector's width (60 of one bit down to one of 60).
Ids are cut into blocks of ``BLOCK``; a block starts at a word of its own and the header has every block's first word,
so blocks decode by themselves and all words of a selector decode in one vectorised step. An id over 60 bits is escaped:
its word has selector 0 and the index of the id in a list of whole 64-bit values.

File: magic, four counts, doc ids, ids a document, block offsets, escaped ids, words; little-endian, 64 bits each.

Null text counts as empty: the end id alone. Rows with the same doc_id come in a fixed order of their texts' hashes; a missing doc_id comes first. Rows
repeated whole are encoded each; they are told apart by where they were read, so ``docs`` should be a written table if it has such rows. Other columns, whatever their names, are ignored. A very long text is encoded by itself and stays in one file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeweave.llm.common import NULL_ID, id_key, let_go, partitions
from citeweave.storage import scratch

MAGIC = b"CWS8B001"
#: How many ids a selector's word holds and their width; selector 0 escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
BLOCK = 4096
#: Bit lengths of small ids.
_BITS = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), escaped ids."""
    x = ids.astype(np.uint64)
    n = len(x)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.uint64)
    blocks = -(-n // BLOCK)
    if int(x.max()) < len(_BITS):
        bits = _BITS[x]
    else:
        bits = np.frexp(x.astype(np.float64))[1].astype(np.uint8)  # at most one too many, for ids over 53 bits
    padded = np.zeros((blocks, BLOCK + 64), np.uint8)
    whole = np.zeros(blocks * BLOCK, np.uint8)
    whole[:n] = bits
    padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    most = {1: padded}
    for p in (1, 2, 4, 8, 16):
        most[2 * p] = np.maximum(most[p][:, :-p], most[p][:, p:])
    chosen = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):  # the largest count that fits is set last
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        fits = np.maximum(most[p][:, :BLOCK], most[p][:, c - p : c - p + BLOCK]) <= WIDTHS[s]
        if s < len(COUNTS) - 1 and not fits.any():
            break  # more ids of fewer bits fit nowhere either
        np.copyto(chosen, s, where=fits)
    # follow the words of all blocks side by side: where the next word starts, a block's end included
    reach = COUNTS.astype(np.int32)[chosen]
    taken = np.zeros((blocks, BLOCK), bool)
    live = np.arange(blocks)
    size = np.minimum(BLOCK, n - live * BLOCK)
    at = np.zeros(blocks, np.int64)
    while len(live):
        taken[live, at] = True
        at = at + reach[live, at]
        more = at < size[live]
        live, at = live[more], at[more]
    first = np.flatnonzero(taken)
    sel = chosen.reshape(-1)[first].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    room = np.minimum((first // BLOCK + 1) * BLOCK, n) - first
    x = np.concatenate([x, np.zeros(64, np.uint64)])
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            src, packed = first[rows], np.zeros(len(rows), np.uint64)
            short = np.flatnonzero(room[rows] < COUNTS[s])  # words at the end of a block
            left = room[rows[short]]
            for k in range(int(COUNTS[s])):
                value = x[src + k]
                value[short[left <= k]] = 0
                packed |= value << np.uint64(k * int(WIDTHS[s]))
            words[rows] |= packed
    rows = np.flatnonzero(sel == 0)
    words[rows] |= np.arange(len(rows), dtype=np.uint64)
    offsets = np.append(np.searchsorted(first, np.arange(0, n, BLOCK)), len(first)).astype(np.int64)
    return words, offsets, x[first[rows]]


def unpack(words: np.ndarray, offsets: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[sel]
    before = np.cumsum(held) - held
    blocks = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = before - before[offsets[:-1]][blocks] + blocks * BLOCK if len(words) else before
    end = np.minimum((blocks + 1) * BLOCK, n)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                to = start[rows] + k
                ok = to < end[rows]
                out[to[ok]] = words[rows[ok]] >> np.uint64(k * int(WIDTHS[s])) & mask
    rows = np.flatnonzero(sel == 0)
    out[start[rows]] = escaped[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def to_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escaped = pack(ids)
    counts = np.array([len(doc_ids), len(ids), len(escaped), len(words)], "<i8")
    parts = [counts, np.array(doc_ids, "<i8"), np.array(lengths, "<i8"), offsets.astype("<i8"), escaped.astype("<u8"), words.astype("<u8")]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, ids a document, ids."""
    if content[:8] != MAGIC:
        raise ValueError("not a token id file")
    a = np.frombuffer(content, "<i8", offset=8)
    docs, n, escapes, n_words = map(int, a[:4])
    blocks = -(-n // BLOCK) + 1
    cut = np.cumsum([4, docs, docs, blocks, escapes, n_words])
    doc_ids, lengths, offsets, escaped, words = (a[i:j] for i, j in zip(cut, cut[1:]))
    return doc_ids, lengths, unpack(words.view("<u8"), offsets, escaped.view("<u8"), n)


#: White space other than lone blanks and line breaks between other characters.
_ODD = "^[ \\n]|[ \\n]$|[ \\n][ \\n]|[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]"
#: Letters and the signs that end their word: two pieces.
_SIGNS = r"(\p{L})([^\s\p{L}\p{N}']+)([ \n]|$)"
#: Pieces that a worker remembers.
KNOWN_MOST = 500_000


def cuts_at_blanks(tokenizer_path: str) -> list[str] | None:
    """Added tokens of a byte-level vocabulary whose pieces are known here: a blank starts one, letters and signs part. None for any other."""
    with open(tokenizer_path, encoding="utf-8") as f:
        said = json.load(f)
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not said.get("normalizer") and model["type"] == "BPE"
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    return [t["content"] for t in said.get("added_tokens", [])] if plain else None


class Pieces:
    """What a worker remembers: each piece's place in one run of ids."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = cuts_at_blanks(tokenizer_path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each piece is asked for once
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.spell = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # a character a byte
        self.line = self.whole(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.ends: list[np.ndarray] = [np.zeros(1, np.int64)]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def remember(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends.append(ends + self.used)
        self.used += len(ids)
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))

    def learn(self, new: list[str]) -> None:
        """Words are encoded many in one text, led by blanks or by line breaks: their ids are cut where their bytes end."""
        led, bare, rest = [], [], []
        for p in new:
            (led if p[:1] == " " and p[1:].isalpha() else bare if p.isalpha() else rest).append(p)
        for i in range(0, len(led), 2_000):
            part = led[i : i + 2_000]
            ids = self.whole(["a" + "".join(part)])[0][1:]
            self.remember(part, ids, np.searchsorted(np.cumsum(self.spell[ids]), np.cumsum([len(p.encode()) for p in part])) + 1)
        for i in range(0, len(bare), 2_000):
            part = bare[i : i + 2_000]
            ids = self.whole(["\n".join(part)])[0]
            ids = ids[~np.isin(ids, self.line)]
            self.remember(part, ids, np.searchsorted(np.cumsum(self.spell[ids]), np.cumsum([len(p.encode()) for p in part])) + 1)
        if rest:
            each = self.whole(rest)
            self.remember(rest, np.concatenate(each), np.cumsum([len(x) for x in each]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.added is None:
            every = self.whole(texts.to_pylist())
            return np.concatenate(every), np.array([len(x) for x in every], np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        cut = pc.replace_substring_regex(pc.if_else(odd, "", texts), _SIGNS, "\\1\0\\2\\3")
        pieces = pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0"), "\0")
        starts = pieces.offsets.to_numpy()[:n] - pieces.offsets.to_numpy()[0]
        numbered = pieces.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = list(map(self.known.get, distinct))
        new = [p for p, k in zip(distinct, place) if k is None]
        if new:
            if len(self.known) + len(new) > KNOWN_MOST:
                self.forget()
                new = distinct
            self.learn(new)
            place = list(map(self.known.__getitem__, distinct))
        place = np.array(place, np.int64)[numbered.indices.to_numpy()]
        ends = np.concatenate(self.ends)
        self.ends = [ends]
        begin, each = ends[place], ends[place + 1] - ends[place]
        ids = self.ids[: self.used]
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(apart):  # such a text is one empty piece so far
            whole = self.whole(texts.take(pa.array(apart)).to_pylist())
            size = np.array([len(x) for x in whole])
            begin[starts[apart]], each[starts[apart]] = self.used + np.cumsum(size) - size, size
            ids = np.concatenate([ids, *whole])
        before = np.cumsum(each) - each
        return ids[np.repeat(begin - before, each) + np.arange(each.sum())], np.add.reduceat(each, starts)


_KNOWN: dict[str, Pieces] = {}


def encoder(tokenizer_path: str):
    """Texts → (ids of all of them, number of ids of each).

    A vocabulary of the usual byte-level kind starts a new piece at a lone blank, around a lone line break, and where letters end
    and signs other than an apostrophe begin. So a text's ids are those of its pieces in a row; a batch's pieces are numbered, each distinct one is
    looked up or encoded once, and the ids are gathered by number. Texts with other white space or with an added token are encoded whole, and so are
    all texts under a vocabulary of another kind.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_path not in _KNOWN:
        _KNOWN[tokenizer_path] = Pieces(tokenizer_path)
    return _KNOWN[tokenizer_path].encode


#: So many bytes of text are encoded together, one text at least.
BATCH_BYTES = 8_000_000


def runs_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Half-open ranges of rows of about ``most`` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most)))
        yield a, b
        a = b


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, ids_per_file: int = 4_000_000) -> None:
    """Write files of whole documents in ascending doc_id order: rows (part, seq, n_docs, n_ids, content), ``content`` being a file's bytes.

    Rows are written by Spark, so they go to any store that Spark reaches, and a lost or repeated task leaves no half file. Documents are
    range-partitioned; a task streams its sorted rows and starts another file after ``ids_per_file`` ids, so a row is bounded.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            nonlocal seq
            ids = np.concatenate(parts)
            values = (part, seq, len(doc_ids), len(ids), to_bytes(doc_ids, lengths, ids))
            seq += 1
            for held in (doc_ids, lengths, parts):
                held.clear()
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["part", "seq", "n_docs", "n_ids", "content"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            for a, b in runs_of(texts, BATCH_BYTES):
                ids, each = encode(texts.slice(a, b - a))
                doc_ids += keys[a:b]
                lengths += (each + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(each), end_id).astype("<u4"))
                if sum(map(len, parts)) >= ids_per_file:
                    yield file()
        if doc_ids:
            yield file()
        let_go()

    # ids that many rows share are split by the hash of the text, and rows repeated whole by where they were read
    order = ["key", "hash", "row"]
    keyed = docs.select(id_key().alias("key"), "text").select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("key", "text")
    dealt.mapInArrow(write, "part int, seq int, n_docs long, n_ids long, content binary").write.option("compression", "none").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files in ``folder``: (part, seq, doc_id, offset in the file, n_tokens, ids_crc32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc_ids, lengths, ids = from_bytes(content.as_py())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(doc_ids), part, np.int32)),
                        pa.array(np.full(len(doc_ids), seq, np.int32)),
                        pa.array(doc_ids, mask=doc_ids == NULL_ID),
                        pa.array(begins),
                        pa.array(np.asarray(lengths)),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )
        let_go()

    return spark.read.parquet(folder).select("part", "seq", "content").mapInArrow(read, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files, read them back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "ids")
    write_ids(docs, folder, tokenizer_path, end_id)
    before = F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    first = spark.read.parquet(folder).select("part", "seq", "n_ids").select("part", "seq", F.coalesce(before, F.lit(0)).alias("first"))  # a row a file
    return read_ids(spark, folder).join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
