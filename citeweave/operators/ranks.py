"""Exact values of given ranks over a whole column, without gathering or sorting it.

A round splits the range of values that is left into ``CELLS`` equal cells and counts them; the cell that holds the rank is the next range. What is
left of it is sorted once it is no more than ``ENOUGH`` rows. Rounds are partial aggregates of a bounded number of rows; a task holds its cells or, in the end, one
bounded cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, ENOUGH = 1024, 10_000


def _cell(low: float, high: float) -> Column:
    """Number of a value's cell between ``low`` and ``high``; it never falls as values grow. Infinite values and NaN, which is last, have cells of their own."""
    width = (high / 2 - low / 2) * 2 / CELLS if math.isfinite(high - low) else (high / CELLS - low / CELLS)
    v = F.col("v")
    inside = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(v / width - low / width).cast("int")))
    return F.when(F.isnan(v) | (v == float("inf")), CELLS).when(v == float("-inf"), -1).otherwise(inside)


def values_at(values: DataFrame, column: str | Column, ranks: list[int]) -> list[float | None]:
    """The values of the given ranks (from 0) among the column's values that are not null, in ascending order; None beyond their number.

    ``values`` is read several times: it should be a table.
    """
    c = F.col(column) if isinstance(column, str) else column
    rows = values.select(c.cast("double").alias("v")).filter("v IS NOT NULL")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    whole = rows.agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    found: dict[int, float | None] = {}
    #: (rows left, smallest and greatest of them, ranks looked for counted from the first of them)
    todo = [(rows, whole.n, whole.low, whole.high, {r: r for r in ranks if 0 <= r < whole.n})]
    while todo:
        left, n, low, high, wanted = todo.pop()
        if not wanted:
            continue
        if low == high and low is not None and n == left.filter(F.col("v") == low).count():
            found |= dict.fromkeys(wanted, low)
            continue
        if n <= ENOUGH:
            own = [r.v for r in left.orderBy("v").collect()]
            found |= {r: own[k] for r, k in wanted.items()}
            continue
        cell = _cell(low, high) if low is not None and low < high else F.when(F.isnan("v") | (F.col("v") == float("inf")), 1).when(F.col("v") == float("-inf"), -1).otherwise(0)
        counts = left.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("cell").collect()
        before = 0
        for r in counts:
            inside = {rank: k - before for rank, k in wanted.items() if before <= k < before + r.n}
            before += r.n
            if not inside:
                continue
            if r.low == r.high or (math.isnan(r.low) and math.isnan(r.high)):
                found |= dict.fromkeys(inside, r.low)
            elif not (math.isfinite(r.low) and math.isfinite(r.high)):
                # +inf and NaN share the last cell: infinity comes first
                infinite = left.filter(F.col("v") == float("inf")).count()
                found |= {rank: float("inf") if k < infinite else float("nan") for rank, k in inside.items()}
            else:
                todo.append((left.filter((F.col("v") >= r.low) & (F.col("v") <= r.high)), r.n, r.low, r.high, inside))
    return [found.get(r) for r in ranks]


def median(values: DataFrame, column: str | Column, n: int | None = None) -> float | None:
    """The exact median, of an even number of values the mean of the middle two; None without values. ``n`` is their number, where it is known."""
    c = F.col(column) if isinstance(column, str) else column
    if n is None:
        n = values.select(c.cast("double").alias("v")).filter("v IS NOT NULL").count()
    if not n:
        return None
    low, high = values_at(values, column, [(n - 1) // 2, n // 2])
    return low if low == high else low + (high - low) / 2 if math.isfinite(high - low) else (low + high) / 2
