"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.storage import remove, scratch, stash  # noqa: F401

#: What a missing doc_id sorts as: before every real id.
NULL_ID = -(2**63)


#: Rows that travel to Python at once: texts are long.
ROWS_AT_ONCE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(at_once)) == 10_000:  # as Spark sets it; a session's own number stays
        spark.conf.set(at_once, str(ROWS_AT_ONCE))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let_go(*memories: dict) -> None:
    """At the end of a task: forget what a worker remembers and give free memory back, Arrow's and that of the C library, for the stages to come."""
    import ctypes

    import pyarrow as pa

    for memory in memories:
        memory.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def id_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


#: Type of ``row_key()``.
ROW = "struct<a:bigint,b:bigint>"


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits for each distinct (id, text): rows repeated whole share them and get the same answer, others do not meet."""
    return F.struct(F.xxhash64(F.col(doc_id), F.col(text)).alias("a"), F.xxhash64(F.lit(1), F.col(text), F.col(doc_id)).alias("b"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of ``edges(a long, b long)`` as (node, root = least node of its component).

    Alternates two joins a round: every neighbour above a node goes to the least node around it, then every
    node's lower neighbours go to the least of them. Each round is written to the shared folder. Nothing but two counts
    reaches the driver, and no neighbour list is ever gathered. The least ones are tables of their own too: joined straight
    from their aggregate they would share its exchange, and Spark splits a hub's rows only where both sides are plain exchanges.
    """
    e = stash(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-e"
    )
    before, now = None, ()
    while before != now:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-m")
        far = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.filter("m <> u").select("u", F.col("m").alias("v"))
        large = stash(far.union(own).filter("u <> v").distinct(), f"{name}-l")
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-n")
        near = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = near.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stash(small, f"{name}-s")
        before, now = now, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: A table of at most so many rows is broadcast.
FEW = 1_000_000


def meet(rows: DataFrame, few: DataFrame, on: str, most: int = FEW) -> DataFrame:
    """Join ``rows`` with ``few``, a written table with one row for each key: broadcast where a count finds at most ``most`` rows in it, else shuffled, hot keys split by Spark."""
    return rows.join(F.broadcast(few) if few.count() <= most else few.hint("merge"), on)
