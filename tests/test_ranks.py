"""Values of given ranks by counting rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import ranks


def frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")


@pytest.mark.parametrize("make", [
    lambda r: r.normal(0, 1, 3001), lambda r: r.integers(0, 5, 2000), lambda r: np.exp(r.normal(0, 40, 2000)), lambda r: [7.0] * 500, lambda r: [1.0], lambda r: [1.0, 2.0],
    lambda r: np.concatenate([r.normal(0, 1e-300, 700), [1e300, -1e300]]), lambda r: [-math.inf] * 3 + list(r.normal(0, 1, 400)) + [math.inf] * 200, lambda r: [-1.7e308, 1.7e308] * 50,
])
def test_median_is_exact(spark, monkeypatch, make):
    monkeypatch.setattr(ranks, "ENOUGH", 20)
    monkeypatch.setattr(ranks, "CELLS", 16)
    values = np.sort(np.array(make(np.random.default_rng(3)), float))
    df = frame(spark, np.random.default_rng(4).permutation(values))
    n = len(values)
    assert ranks.values_at(df, "v", [0, n // 3, n - 1, n]) == [values[0], values[n // 3], values[n - 1], None]
    low, high = values[(n - 1) // 2], values[n // 2]
    assert ranks.median(df, "v") == pytest.approx(low if low == high else low / 2 + high / 2, rel=1e-15)


def test_nulls_and_nan(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ENOUGH", 2)
    assert ranks.median(frame(spark, []), "v") is None and ranks.median(frame(spark, [None, None]), "v") is None
    assert ranks.median(frame(spark, [3.0, None, 1.0]), "v") == 2.0
    got = ranks.values_at(frame(spark, [float("nan"), 1.0, math.inf, 2.0, float("nan")]), "v", [0, 2, 3])
    assert got[:2] == [1.0, math.inf] and math.isnan(got[2])


def test_ten_million_values_without_a_sort(spark):
    df = spark.range(10_000_000).select(((F.col("id") * 7_919) % 10_000_019).cast("double").alias("v"))
    plan = df.groupBy(ranks._cell(0.0, 1e7).alias("cell")).agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Sort" not in plan and "collect" not in plan
    values = np.sort((np.arange(10_000_000, dtype=np.int64) * 7_919) % 10_000_019)
    assert ranks.median(df, "v", n=10_000_000) == (values[4_999_999] + values[5_000_000]) / 2
