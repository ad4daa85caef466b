"""Order MinHash of whole texts, and the likeness of each text to an edit of it and to the next text.

Tokens are runs of at most eight non-blank characters; a k-mer is five tokens, with four blanks assumed before and after
the text so that short texts have k-mers too. Equal k-mers of a text are numbered; each (k-mer, number) has one hash
(number 1 that of the k-mer), which deals it to one of ``2 ** M_BITS`` buckets. In each bucket the ``2`` least hashes are selected, put in text
order and hashed as a tuple, so that a signature notices order and copies as edit distance does. A bucket with one k-mer takes the next hash
beyond it (the least of all behind the last), so that short texts, whose buckets are thin, carry order too. Two signatures'
likeness is the share of buckets, used by either, with the same tuple.

Built-in column functions only. Null text counts as empty; all empty texts have one fingerprint. Rows with the same doc_id
are ordered by the hash of their text; rows repeated whole follow each other in one task. A missing doc_id comes before all others. Other columns,
whatever their names, are ignored. Texts are taken whole; beyond 2 ** 27 tokens positions count as equal.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citeweave.llm.common import id_key, partitions

K, M_BITS = 5, 6
#: Bits of a packed position and of a packed hash: 63 in all, so that packed values sort as numbers.
POS_BITS, HASH_BITS = 27, 36
#: Bits of a tuple's hash beside its bucket in a signature's value.
TUPLE_BITS = 25
#: Rows that are looked at, on average, for each cut of the ids.
SEEN = 64


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: array<int>, one ``bucket << TUPLE_BITS | tuple hash`` per used bucket, ascending."""
    keep = df.columns
    low, pos = (1 << HASH_BITS) - 1, (1 << POS_BITS) - 1
    pad = lambda first: ", ".join(f"{first + i}L" for i in range(K - 1))
    window = ", ".join(f"get(__t, i + {j})" for j in range(K))
    steps = [
        ("__t", rf"concat(array({pad(1)}), transform(regexp_extract_all(coalesce({text}, ''), '\\S{{1,8}}', 0), w -> xxhash64(w)), array({pad(K)}))"),
        ("__k", f"sort_array(transform(sequence(0, size(__t) - {K}), i -> shiftleft(xxhash64({window}) & {low}L, {POS_BITS}) | least(i, {pos})))"),
        ("__r", f"filter(sequence(0, size(__k) - 1), i -> i = 0 OR shiftright(get(__k, i), {POS_BITS}) <> shiftright(get(__k, i - 1), {POS_BITS}))"),
        (
            "__k",
            "if(size(__r) = size(__k), __k, sort_array(zip_with(__k, "
            "flatten(zip_with(__r, concat(slice(__r, 2, size(__r)), array(size(__k))), (a, b) -> sequence(1, b - a))), "
            f"(x, o) -> if(o = 1, x, shiftleft(xxhash64(shiftright(x, {POS_BITS}), o) & {low}L, {POS_BITS}) | (x & {pos}L)))))",
        ),
        ("__b", f"filter(sequence(0, size(__k) - 1), i -> i = 0 OR shiftright(get(__k, i), {POS_BITS + HASH_BITS - M_BITS}) <> shiftright(get(__k, i - 1), {POS_BITS + HASH_BITS - M_BITS}))"),
    ]
    names: list[str] = []
    for name, sql in steps:
        df = df.select(*keep, *(n for n in names if n != name), F.expr(sql).alias(name))
        names = [n for n in names if n != name] + [name]
    bucket = f"shiftright(get(__k, i), {POS_BITS + HASH_BITS - M_BITS})"
    second = "if(size(__k) = 1, NULL, get(__k, (i + 1) % size(__k)))"
    hashed = lambda a, b: f"xxhash64(shiftright({a}, {POS_BITS}), shiftright({b}, {POS_BITS}))"
    one = "get(__k, i)"
    tuple_hash = f"if({one} & {pos}L <= coalesce({second} & {pos}L, {pos}L), {hashed(one, second)}, {hashed(second, one)})"
    return df.select(*keep, F.expr(f"transform(__b, i -> cast(shiftleft({bucket}, {TUPLE_BITS}) | ({tuple_hash} & {(1 << TUPLE_BITS) - 1}L) as int))").alias(out))


def as_text(sig: Column) -> Column:
    """Eight hexadecimal digits a bucket, of its number and tuple."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    of = lambda sig: F.transform(sig, lambda x: F.shiftright(x, TUPLE_BITS))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(of(a), of(b)))


def places(docs: DataFrame) -> Column:
    """Where a row stands among all: struct(k: doc_id, h: hash of its text), so that an id that many rows share is cut as well."""
    return F.struct(id_key().alias("k"), F.xxhash64("text").alias("h"))


def bounds(docs: DataFrame, n: int) -> list[tuple[int, int]]:
    """At most ``n`` places, ascending and each a row's own, the least first, that cut the rows into runs of like length.

    A sample by hash, of bounded size, gives the cuts; the least place in each run, which all rows are asked for, takes the cut's stead.
    """
    rows = docs.select(places(docs).alias("p"))
    count = rows.count()
    if not count:
        return []
    share = min(1.0, SEEN * n / count)
    seen = rows.filter(F.pmod(F.xxhash64("p", F.lit("cut")), F.lit(1_000_000)) < int(share * 1_000_000)).distinct().orderBy("p").collect()
    cuts = [tuple(r.p) for r in seen]
    cuts = cuts[:: max(1, len(cuts) // n)][:n]
    return sorted(tuple(r.first) for r in rows.groupBy(run_of(F.col("p"), cuts).alias("run")).agg(F.min("p").alias("first")).collect())


def _array(cuts: list[tuple[int, int]]) -> Column:
    return F.from_json(F.lit(json.dumps([{"k": k, "h": h} for k, h in cuts])), "array<struct<k:bigint,h:bigint>>")


def run_of(place: Column, cuts: list[tuple[int, int]]) -> Column:
    """Index of the last cut not above ``place`` (-1 before the first): among every ``s``-th cut first, then among ``s``."""
    s = max(1, isqrt(len(cuts)))
    last = lambda some: F.size(F.filter(some, lambda x: x <= place)) - 1
    c = F.greatest(last(_array(cuts[::s])), F.lit(0))
    return F.lit(s) * c + last(F.slice(_array(cuts), F.lit(s) * c + 1, F.lit(s)))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row by place, the first row's after the last, for each carried column.

    Rows are cut into runs. The first row of a run is also sent to the end of the run before, so one shuffle by run is all.
    """
    cuts = bounds(docs, 2 * partitions(docs.sparkSession))
    if not cuts:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    n, place, run = len(cuts), F.col("__place"), F.col("__run")
    dealt = docs.select("*", places(docs).alias("__place")).select("*", run_of(place, cuts).alias("__run"))
    at = lambda r, tail: F.struct(r.alias("r"), F.lit(tail).alias("tail"))
    first = F.get(_array(cuts), run) == place
    dealt = dealt.select("*", F.explode(F.when(first, F.array(at(run, 0), at(F.pmod(run - 1, F.lit(n)), 1))).otherwise(F.array(at(run, 0)))).alias("__at")).select("*", "__at.r", "__at.tail")
    ahead = Window.partitionBy("r").orderBy("tail", "__place")
    return dealt.select(*docs.columns, "tail", *(F.lead(c).over(ahead).alias(f"next_{c}") for c in carried)).filter("tail = 0").drop("tail")


def order_minhash(docs: DataFrame) -> DataFrame:
    """The query's columns for documents (doc_id, text)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
    df = with_next(with_signature(df, "text", "sig"), ["text", "sig"])
    df = df.select(
        "doc_id", "n_chars", "sig", "next_sig",
        F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))").alias("edited"),
    )
    df = with_signature(df, "edited", "edited_sig")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
