"""Leave out rows whose key nobody asks for, before they are shuffled.

The keys asked for become a Bloom filter of one hash: 64-bit words, made by ``bit_or`` and gathered as arrays, a row each, so that what is broadcast takes
little more than its bits. A row stays where its key's bit is set: every row that is asked for, and about one in ``BITS_A_KEY`` of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY = 16
#: Words of a filter at most (8 MB of bits); with more keys than it has bits for at a half of them set there is no filter.
WORDS_MOST = 1 << 20
#: Words of a row.
BLOCK = 1 << 10


def _bit(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def filter_words(wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, int] | None:
    """(block, __sets) of the filter, ``BLOCK`` words a row in their order, and its number of bits; None where the keys are too many for it."""
    n = wanted.select(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    bits = min(1 << max(6, (BITS_A_KEY * max(n, 1) - 1).bit_length()), 64 * WORDS_MOST)
    if 2 * n > bits:
        return None
    rows = wanted.select(_bit(keys, bits).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("bit"))
    every = wanted.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))  # words without a bit keep their places
    words = rows.union(every).groupBy("word").agg(F.bit_or("bit").alias("set"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "set")))
    return words.groupBy((F.col("word") / BLOCK).cast("long").alias("block")).agg(F.transform(in_order, lambda w: w["set"]).alias("__sets")), bits


def asked_for(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` less most of those whose ``keys`` no row of ``wanted`` (a table that is cheap to read) has. Keys of both sides have the same types."""
    made = filter_words(wanted, keys)
    if made is None:
        return rows
    words, bits = made
    at, per_row = _bit(keys, bits), 64 * BLOCK
    held = rows.withColumn("__at", at).join(F.broadcast(words.withColumnRenamed("block", "__block")), F.expr(f"__at div {per_row}") == F.col("__block"))
    is_set = F.expr(f"(shiftright(get(__sets, cast(shiftright(__at % {per_row}, 6) AS int)), cast(__at % 64 AS int)) & 1L) = 1L")
    return held.filter(is_set).select(*rows.columns)
