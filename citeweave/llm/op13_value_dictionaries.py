"""Product codes of integer vectors by per-dimension value dictionaries.

Components become floor(256 x). Vectors are kept in blocks; each dimension of a block has a dictionary of the distinct integers it
holds, and the vectors hold its codes. To assign parts to their codebook's nearest entries, the squared differences of all dictionary
values to all entries are tabulated a dimension, and a part's distances are gathers from these tables by code, added up.

Rows whose vector is null, has no component, or holds a null or non-finite one are dropped, and so are rows whose length is not that of
the least kept vec_id's vector; without 16 equal parts no row is left. Rows with one vec_id all count; where the first entries are chosen they come in order of their
vectors. A missing vec_id comes after all others. With fewer rows than entries, codebooks are as small. Components beyond a bound that keeps
squared distances in 64 bits (some 8 million at 64 dimensions, before the factor) count as that bound. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import meet, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block.
BLOCK_ROWS = 4096


def bound(dimensions: int) -> int:
    """Components up to this keep the summed squared distances of a vector below 2**62."""
    return math.isqrt(2**62 // dimensions) // 2


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): rows whose vectors are whole."""
    good = (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("x"))


def as_integers(x: Column, dimensions: int) -> Column:
    most = float(bound(dimensions))
    return F.transform(x, lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(v.cast("double") * SCALE).cast("double"))).cast("long"))


class Block:
    """Vectors of one length as dictionary codes."""

    def __init__(self, dictionaries: list[np.ndarray], codes: np.ndarray):
        self.dictionaries, self.codes = dictionaries, codes  # codes: a row a dimension

    @classmethod
    def of(cls, x: np.ndarray) -> Block:
        pairs = [np.unique(column, return_inverse=True) for column in x.T]
        return cls([values for values, _ in pairs], np.array([codes for _, codes in pairs], np.uint16))

    def vectors(self) -> np.ndarray:
        return np.array([values[codes] for values, codes in zip(self.dictionaries, self.codes)]).T

    def assign(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part and its squared distance; ties go to the lower index. ``books``: parts x entries x width."""
        parts, entries, width = books.shape
        n = self.codes.shape[1]
        nearest, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
        for p in range(parts):
            far = np.zeros((n, entries), np.int64)
            for j in range(width):
                values = self.dictionaries[p * width + j]
                far += ((values[:, None] - books[p, None, :, j]) ** 2)[self.codes[p * width + j]]
            nearest[:, p] = far.argmin(axis=1)
            error[:, p] = far[np.arange(n), nearest[:, p]]
        return nearest, error


def blocks(integers: DataFrame, dimensions: int) -> DataFrame:
    """(vec_ids, labels, values, sizes, codes): a row a block, its dictionaries end to end and its codes as 16-bit numbers, a dimension after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(i, BLOCK_ROWS)
                block = Block.of(own.column("x").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dimensions))
                row = [own.column("vec_id").to_pylist(), own.column("label").to_pylist(), np.concatenate(block.dictionaries), [len(v) for v in block.dictionaries], block.codes.tobytes()]
                types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["vec_ids", "labels", "values", "sizes", "codes"])

    return integers.mapInArrow(pack, "vec_ids array<long>, labels array<long>, values array<long>, sizes array<int>, codes binary")


def read_block(batch: pa.RecordBatch, i: int) -> Block:
    values, sizes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("values", "sizes"))
    return Block(np.split(values, np.cumsum(sizes)[:-1]), np.frombuffer(batch.column("codes")[i].as_py(), np.uint16).reshape(len(sizes), -1))


def refine(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of the means of their parts; what reaches the driver is one row for each entry."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = read_block(batch, i)
                nearest, _ = block.assign(books)
                x = block.vectors()
                for p in range(parts):
                    np.add.at(total, nearest[:, p] + p * entries, x[:, p * width : (p + 1) * width])
                    count[p * entries : (p + 1) * entries] += np.bincount(nearest[:, p], minlength=entries)
        used = np.flatnonzero(count)
        totals = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * width, pa.int32()), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), totals], names=["entry", "n", "total"])

    of_task = packed.mapInArrow(sums, "entry long, n long, total array<long>")
    added = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(width)]
    new = books.reshape(-1, width).copy()
    for row in of_task.groupBy("entry").agg(F.sum("n").alias("n"), *added).collect():  # parts x entries rows at most
        new[row.entry] = [int(row[f"t{j}"]) // row.n for j in range(width)]
    return new.reshape(books.shape)


def trained(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Blocks of all kept vectors, and the codebooks (None where no row has the parts)."""
    rows = kept(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    dimensions = len(first[0].x) if first else PARTS
    width, rest = divmod(dimensions, PARTS)
    whole = rows.filter((F.size("x") == dimensions) & F.lit(not rest)).withColumn("x", as_integers(F.col("x"), dimensions))
    packed = stash(blocks(whole, dimensions), "vector-blocks")
    least = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    if not least:
        return packed, None
    start = np.array([r.x for r in least], np.int64)
    books = start.reshape(len(start), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refine(packed, books)
    return packed, books


def encoded(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distance left."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nearest, error = read_block(batch, i).assign(books)
                digits = memoryview(nearest.astype(np.uint8).tobytes()).hex()
                size = 2 * books.shape[0]
                code = [digits[k : k + size] for k in range(0, len(digits), size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[i].values, batch.column("labels")[i].values, pa.array(code, pa.string()), pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"]
                )

    return packed.mapInArrow(encode, "vec_id long, label long, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with the entries that ``code`` names, as ``x array<long>``."""
    names = {f"{p:02d}{e:02x}": books[p, e].tolist() for p in range(books.shape[0]) for e in range(books.shape[1])}
    table = F.create_map(*(F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for pair in names.items() for v in pair))
    parts = [F.element_at(table, F.concat(F.lit(f"{p:02d}"), F.substring("code", 2 * p + 1, 2))) for p in range(books.shape[0])]
    return codes.withColumn("x", F.concat(*parts))


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row."""
    packed, books = trained(vectors)
    if books is None:
        books, sha = np.zeros((PARTS, 1, 1), np.int64), hashlib.sha256(b"").hexdigest()
    else:
        sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = stash(encoded(packed, books).withColumn("named", F.struct("label")), "vector-codes")  # a struct joins nulls together
    sums = stash(codes.groupBy("named").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return meet(codes, sums, "named").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


#: The same rows in SQL: 16 parts of four components, as in ``embeddings``.
SQL = """
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
numbered AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS k, vec_id, label, x FROM whole),
parts AS (SELECT k, vec_id, label, p, list_slice(x, 4 * p + 1, 4 * p + 4) AS v FROM numbered, range(16) AS r(p)),
b0 AS (SELECT p, k - 1 AS e, v FROM parts WHERE k <= 64),
{rounds}
scored AS (SELECT k, p, e, d FROM (SELECT k, p, e, d, row_number() OVER (PARTITION BY k, p ORDER BY d, e) AS n FROM (
  SELECT parts.k, parts.p, b.e, {far} AS d FROM parts JOIN b2 b ON parts.p = b.p)) WHERE n = 1),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM scored GROUP BY k),
sha AS (SELECT sha256(string_agg(v[1] || ',' || v[2] || ',' || v[3] || ',' || v[4], ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT n.vec_id, code, error, sum(error) OVER (PARTITION BY n.label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN numbered n USING (k), sha
"""
_FAR = " + ".join(f"(parts.v[{j}] - b.v[{j}]) * (parts.v[{j}] - b.v[{j}])" for j in range(1, 5))
_ROUND = """
a{r} AS (SELECT k, p, e FROM (SELECT parts.k, parts.p, b.e, row_number() OVER (PARTITION BY parts.k, parts.p ORDER BY {far}, b.e) AS n FROM parts JOIN b{r} b ON parts.p = b.p) WHERE n = 1),
m{r} AS (SELECT parts.p, a.e, [{means}] AS v FROM parts JOIN a{r} a ON parts.k = a.k AND parts.p = a.p GROUP BY parts.p, a.e),
b{s} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e),"""


def oracle() -> str:
    floor = ", ".join(f"CAST((sum(parts.v[{j}]) - ((sum(parts.v[{j}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for j in range(1, 5))
    return SQL.format(rounds="".join(_ROUND.format(r=r, s=r + 1, far=_FAR, means=floor) for r in range(ROUNDS)), far=_FAR)
