"""Packing of documents into sequences of several permitted lengths.

Lengths are cut into pieces of at most the largest sequence. In each shard pieces go from long to short to the open bin with
the least room that holds them. Where none does, a bin is opened whose size has the least cost per token: for each
permitted size that holds the piece the rest is filled, in thought, with the longest pieces still to come, and size plus
``OVERHEAD`` is divided by what it would hold. At the end every bin shrinks to the least permitted size of its contents.

Shards are dealt by hash and hold about ``SHARD_TOKENS`` tokens, so a task's work is bounded and no bin spans shards; rows repeated whole
are dealt apart by where they were read, so bins depend on how the input is split. A document without tokens (null or empty text) still has its end token: length 1. A text longer than
the largest sequence becomes several pieces. A missing doc_id stays missing. Repeated rows are packed each. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import stash

SIZES = (256, 512, 1024, 2048, 4096)
OVERHEAD = 8
SHARD_TOKENS = 4_000_000
#: Rows repeated whole go to so many shards at most.
COPIES = 4096
OUT = "doc_id long, piece int, start long, n_tokens int, shard int, bin_id long, bin_size int, bin_offset int"


def n_tokens(text: str = "text") -> Column:
    """Runs of characters that are not white space (of Unicode), and an end token."""
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    return F.when(bare == "", F.lit(1)).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 2).cast("long")


def pack_lengths(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length (none above the largest size), and the bins' sizes. Ties go to the earlier length."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=sizes[-1] + 1)
    present = np.flatnonzero(left).tolist()  # lengths that are still to come, ascending
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    capacity: list[int] = []
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending

    def held(size: int, first: int) -> int:
        """What a bin of ``size`` would hold: ``first`` and then the longest that fit."""
        room, total, taken = size - first, first, {}
        i = bisect_left(present, room + 1) - 1
        while room and i >= 0:
            n = present[i]
            fit = min(room // n, int(left[n]) - taken.get(n, 0))
            if fit > 0:
                taken[n] = taken.get(n, 0) + fit
                room, total = room - fit * n, total + fit * n
            i = min(i - 1, bisect_left(present, room + 1) - 1)
        return total

    for row in order.tolist():
        n = int(lengths[row])
        left[n] -= 1
        if not left[n]:
            present.pop(bisect_left(present, n))
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / held(s, n), s))
            b, room = len(capacity), size
            capacity.append(size)
            used.append(0)
        bin_of[row], offset[row] = b, used[b]
        used[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bin_of, offset, [next(s for s in sizes if s >= u) for u in used]


def best_fit(docs: DataFrame, length: Column | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """A row a piece: where it starts in its document, and its bin, the bin's size and its offset there."""
    most = max(sizes)
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES))).alias("deal"), (n_tokens() if length is None else length).cast("long").alias("n"))
    doc = stash(doc, "lengths")  # texts are read once, and a task that runs again deals as before
    total = doc.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_TOKENS))
    pieces = doc.select("*", F.explode(F.expr(f"sequence(0, cast((n - 1) div {most} as int))")).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * F.lit(most)).cast("long").alias("start"),
        F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("deal", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack_lengths(shard["n_tokens"].to_numpy().astype(np.int64), sizes)
        shard = shard.assign(bin_id=bins + (shard["shard"].to_numpy().astype(np.int64) << 32), bin_size=np.array(final)[bins], bin_offset=offsets)
        return shard[["doc_id", "piece", "start", "n_tokens", "shard", "bin_id", "bin_size", "bin_offset"]]

    return pieces.groupBy("shard").applyInPandas(pack, OUT)
