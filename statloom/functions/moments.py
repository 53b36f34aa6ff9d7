"""Sums of products for small regressions, in one aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def weighted_moments(
    df: DataFrame, xs: list[Column], y: Column, w: Column | None = None
) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Row count, X'WX, X'Wy and y'Wy of expressions, in one aggregation."""
    w = F.lit(1.0) if w is None else w
    k = len(xs)
    aggs = [F.count("*").alias("n"), F.sum(w * y * y).alias("yy")]
    aggs += [F.sum(w * xs[i] * xs[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(w * xs[i] * y).alias(f"y{i}") for i in range(k)]
    row = df.agg(*aggs).first()
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"x{i}_{j}"] or 0.0
    return row["n"], xx, np.array([row[f"y{i}"] or 0.0 for i in range(k)]), row["yy"] or 0.0


def linear(intercept: float, weights, xs: list[Column]) -> Column:
    """intercept + Σ wᵢ xᵢ as one column expression."""
    out = F.lit(float(intercept))
    for b, x in zip(weights, xs):
        out = out + F.lit(float(b)) * x
    return out
