"""Removal of repeated runs of lines by winnowing.

The unit is a line, cut further behind sentence ends, because a passage pasted into a paragraph shares its first and last
line with other text. Short runs of units (``SHORT`` words or more) are hashed; spans are as many units as hold ``WORDS`` words, the
fewest from each first unit and the fewest up to each last unit. Of the short runs in a span the one with the least hash is a fingerprint. Two texts
with a run of ``WORDS`` words in common have a span in common, and so the same fingerprint at the same place of it.

A fingerprint that stands in several places is joined with its first one (by doc_id), and the match is extended both ways, unit by unit,
as far as the spans that chose the fingerprint reach; what matches over ``WORDS`` words or more is a repeated run and goes. A
fingerprint may be a frequent line whose first place has nothing else in common with a later run: spans that no extension covered are joined once more
by the hash of all their units, with the first of them, and go if all units are equal. So of every span the first copy stays and no other, nothing goes by one
64-bit hash alone (units are compared by a hash of their own), and documents never meet each other, only first places.

Units are equal when they are after trimming; empty ones never start a run. Null and empty texts stay as they are, a missing
doc_id comes before all others, rows repeated whole (same doc_id and text) count as one document and all get its answer.
Other columns pass through. A very long text is one value in memory, as are the places of its own that go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import ROW, id_key, let_go, row_key, stash
from citeweave.operators.reduce import asked_for

WORDS, SHORT = 25, 8
#: An odd number and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_BLANK = bytes(16)
_CUT = re.compile(r"[.!?]+[\"')\]]*[ \t]+|\n+")


def units(text: str) -> list[str]:
    """Lines and sentences with what separates them; joined, they are the text."""
    out, a = [], 0
    for m in _CUT.finditer(text):
        out.append(text[a : m.end()])
        a = m.end()
    if a < len(text):
        out.append(text[a:])
    return out


def both_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each unit (0 if blank), another of its own, and its words."""
    from xxhash import xxh3_128_digest

    bare = [u.strip() for u in units(text)]
    h = np.frombuffer(b"".join([xxh3_128_digest(u) if u else _BLANK for u in bare]), "<i8").reshape(-1, 2)
    return h[:, 0], h[:, 1], np.array([u.count(" ") + 1 if u else 0 for u in bare], np.int32)


def hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each unit (0 if blank) and its words."""
    h, _, words = both_hashes(text)
    return h, words


def spans_of(words: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first unit, unit behind the last) of the spans of texts laid end to end."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    stop = np.searchsorted(total, total[:-1] + least)  # the span from i is [i, stop[i])
    full = words > 0
    a = np.flatnonzero(full & (stop <= ends[text]))
    last = np.flatnonzero(full & (total[1:] - total[begins[text]] >= least))
    start = np.searchsorted(total, total[last + 1] - least, "right") - 1
    other = stop[start] != last + 1  # not among those from a first unit
    a, b = np.concatenate([a, start[other]]), np.concatenate([stop[a], last[other] + 1])
    return text[a], a, b


def run_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of h[a + k] * BASE ** k modulo 2 ** 64 over each run [a, b)."""
    power = lambda x: np.cumprod(np.array([1, *[x] * len(h)], np.uint64))
    so_far = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.view(np.uint64) * power(_BASE)[:-1], dtype=np.uint64)])
    mixed = (so_far[b] - so_far[a]) * power(_UNBASE)[a]
    mixed ^= mixed >> np.uint64(32)  # low bits count as much as high ones when the least is taken
    return (mixed * np.uint64(_BASE)).view(np.int64)


def fingerprints(h: np.ndarray, words: np.ndarray, lengths: np.ndarray, least: int, short: int = SHORT) -> tuple[np.ndarray, ...]:
    """(text, unit, hash, first unit and unit behind the last of all spans that chose it) of each fingerprint of texts laid end to end."""
    text, a, b = spans_of(words, lengths, least)
    if not len(a):
        return (np.empty(0, np.int64),) * 5
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.cumsum(lengths)
    stop = np.searchsorted(total, total[:-1] + min(short, least))
    starts = np.flatnonzero((words > 0) & (stop <= ends[np.repeat(np.arange(len(lengths)), lengths)]))
    mark = run_hash(h, starts, stop[starts])
    order = np.argsort(mark.view(np.uint64), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # short runs inside a span: from its first unit on, as long as they end inside
    low, high = np.searchsorted(starts, a), np.searchsorted(stop[starts], b, "right")
    chosen = order[np.minimum.reduceat(np.append(rank, len(rank)), np.stack([low, high], 1).ravel())[::2]]
    by = np.argsort(chosen, kind="stable")
    chosen, a, b, text = chosen[by], a[by], b[by], text[by]
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    one = chosen[first]
    return text[first], starts[one], mark[one], np.minimum.reduceat(a, first), np.maximum.reduceat(b, first)


def agreement(own: np.ndarray, at: int, other: np.ndarray, there: int) -> tuple[int, int]:
    """The stretch of ``own`` around ``at`` that agrees with ``other`` around ``there``, as a half-open range."""
    back, ahead = min(at, there), min(len(own) - at, len(other) - there)
    same = own[at - back : at + ahead] == other[there - back : there + ahead]
    unlike = np.flatnonzero(~same)
    k = int(np.searchsorted(unlike, back))
    low = int(unlike[k - 1]) + 1 if k else 0
    high = int(unlike[k]) if k < len(unlike) else len(same)
    return at - back + low, max(at - back + high, at - back + low)


def strip_units(text: str, gone: list[tuple[int, int]]) -> str:
    """``text`` without the units in ``gone``; a lost line break is kept between what stays."""
    parts = units(text)
    lost = np.zeros(len(parts), bool)
    for a, b in gone:
        lost[a:b] = True
    out: list[str] = []
    broke = False
    for part, off in zip(parts, lost.tolist()):
        if off:
            broke |= "\n" in part
            continue
        if broke and out and not out[-1].endswith("\n"):
            out[-1] = out[-1].rstrip() + "\n"
        broke = False
        out.append(part)
    return "".join(out).strip("\n") if not lost[-1:].any() else "".join(out).rstrip()


def slices(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The bytes of ``values[a:b]`` for each a and b."""
    size = b - a
    before = np.cumsum(size) - size
    data = values[np.repeat(a - before, size) + np.arange(size.sum())]
    ends = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def _fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(key, id, mark, unit, at, near, words): each fingerprint, the hashes of the units in its spans and their words; it is the ``at``-th of them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 250):
                part = batch.slice(i, 250)
                h, other, words = zip(*(both_hashes(text) for text in part.column(2).to_pylist()))
                lengths = np.array([len(x) for x in h])
                other, words = np.concatenate(other), np.concatenate(words)
                row, unit, mark, a, b = fingerprints(np.concatenate(h), words, lengths, least)
                begins = (np.cumsum(lengths) - lengths)[row]
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row), part.column(1).take(row), pa.array(mark), pa.array(unit - begins, pa.int32()), pa.array(unit - a, pa.int32()),
                        slices(other.astype("<i8"), a, b), slices(np.minimum(words, 65535).astype("<u2"), a, b),
                    ],
                    names=["key", "id", "mark", "unit", "at", "near", "words"],
                )
        let_go()

    rows = docs.filter("text <> ''").select(row_key().alias("key"), id_key().alias("id"), "text")
    return rows.mapInArrow(make, f"key {ROW}, id long, mark long, unit int, at int, near binary, words binary")


def _extended(pairs: DataFrame, least: int) -> DataFrame:
    """(key, id, a, b, span, near): repeated runs of the later places (span is null), and the spans that no extension covered, by the hash of their units."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "a", "b", "span", "near"]
        for batch in batches:
            # where all spans of both places agree there is no more to extend
            alike = pc.and_(pc.equal(batch.column("at"), batch.column("first_at")), pc.equal(batch.column("near"), batch.column("first_near")))
            same = batch.filter(alike)
            begin = pc.subtract(same.column("unit"), same.column("at"))
            end = pc.add(begin, pc.cast(pc.divide(pc.binary_length(same.column("near")), 8), pa.int32()))
            nothing = (pa.nulls(same.num_rows, t) for t in (pa.int64(), pa.binary()))
            yield pa.RecordBatch.from_arrays([same.column("key"), same.column("id"), begin, end, *nothing], names=names)
            batch = batch.filter(pc.invert(alike))
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("unit", "at", "near", "words", "first_at", "first_near")]
            for k, (unit, at, near, words, there, first) in enumerate(zip(*columns)):
                own, words = np.frombuffer(near, "<i8"), np.frombuffer(words, "<u2").astype(np.int64)
                low, high = agreement(own, at, np.frombuffer(first, "<i8"), there)
                begin = unit - at
                if words[low:high].sum() >= least:
                    out.append((k, begin + low, begin + high, None, None))
                else:
                    low = high = at
                if (low, high) == (0, len(own)):
                    continue
                _, a, b = spans_of(words, np.array([len(own)]), least)
                left = ~((a >= low) & (b <= high)) & (a <= at) & (b > at)
                a, b = a[left], b[left]
                out += [(k, begin + x, begin + y, z, near[8 * x : 8 * y]) for x, y, z in zip(a.tolist(), b.tolist(), run_hash(own, a, b).tolist())]
            row, a, b, span, near = zip(*out) if out else [()] * 5
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(row), batch.column("id").take(row), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(span, pa.int64()), pa.array(near, pa.binary())], names=names
            )
        let_go()

    return pairs.mapInArrow(extend, f"key {ROW}, id long, a int, b int, span long, near binary")


def repeated_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(key, gone): for each document with repeated runs, their units as half-open ranges. ``key`` is ``row_key()``."""
    marks = stash(_fingerprints(docs, least), "fingerprints")
    several = stash(marks.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1").select("mark"), "repeated-marks")
    places = stash(asked_for(marks, several, ["mark"]), "places")
    first = places.groupBy("mark").agg(F.min(F.struct("id", "key", "unit", "at", "near")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    # a table of its own, so that both sides of the join are plain exchanges, which Spark splits where a mark is hot
    first = stash(first.select("mark", *(F.col(f"f.{c}").alias(f"first_{c}") for c in ("key", "unit", "at", "near"))), "first-places")
    later = places.join(first, "mark").filter((F.col("key") != F.col("first_key")) | (F.col("unit") != F.col("first_unit")))
    found = stash(_extended(later.select("key", "id", "unit", "at", "near", "words", "first_at", "first_near"), least), "extended")
    spans = found.filter("span IS NOT NULL")
    held = spans.groupBy("span").agg(F.min(F.struct("id", "key", "a", "near")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    held = stash(held.select("span", *(F.col(f"f.{c}").alias(f"first_{c}") for c in ("key", "a", "near"))), "first-spans")
    again = asked_for(spans, held, ["span"]).join(held, "span").filter("near = first_near").filter((F.col("key") != F.col("first_key")) | (F.col("a") != F.col("first_a")))
    gone = found.filter("span IS NULL").select("key", "a", "b").union(again.select("key", "a", "b"))
    return gone.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def without_repeats(docs: DataFrame, least: int = WORDS, flags: tuple[str, str] = ("repeats", "emptied")) -> DataFrame:
    """``docs`` with repeated runs cut from ``text`` and two flags: something was cut; nothing else was left.

    Columns of ``docs`` that have the flags' names are replaced.
    """
    gone = repeated_runs(docs, least)
    joined = docs.withColumn("__key", row_key()).join(gone.withColumnRenamed("key", "__key").withColumnRenamed("gone", "__gone"), "__key", "left")

    @F.arrow_udf(T.StringType())
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        ends = spans.offsets.to_numpy()
        a, b = (spans.values.field(k).to_pylist() for k in ("a", "b"))
        at = zip(ends[:-1].tolist(), ends[1:].tolist())
        return pa.array([strip_units(t, list(zip(a[i:j], b[i:j]))) if t is not None and i < j else None for t, (i, j) in zip(text.to_pylist(), at)], pa.string())

    hit = F.col("__gone").isNotNull()
    columns = [c for c in docs.columns if c not in flags]
    out = joined.select(*columns, "__gone", cut(F.when(hit, F.col("text")), F.col("__gone")).alias("__cut"))
    return out.select(
        *(F.coalesce("__cut", "text").alias("text") if c == "text" else F.col(c) for c in columns),
        F.col("__gone").isNotNull().alias(flags[0]),
        (F.col("__gone").isNotNull() & (F.trim("__cut") == "")).alias(flags[1]),
    )
