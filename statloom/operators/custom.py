"""User functions: on the whole DataFrame, on batches, and per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.result import ProfileResult, as_list, require_columns


def custom_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> ProfileResult:
    """Apply a function from DataFrame to DataFrame; anything else it returns is an error."""
    out = df.transform(lambda d: _checked(fn(d)))
    metrics = df.agg(F.count("*").alias("rows_in")).crossJoin(out.agg(F.count("*").alias("rows_out")))  # one row each
    return ProfileResult(out, {}, metrics.withColumn("columns_out", F.lit(len(out.columns))))


def _checked(out) -> DataFrame:
    if not isinstance(out, DataFrame):
        raise ValueError(f"the function must return a DataFrame, not {type(out).__name__}")
    return out


def custom_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> ProfileResult:
    """Run a row-wise pandas function on Arrow batches, on the executors."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return ProfileResult(df.mapInPandas(each, schema))


def custom_grouped(
    df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_group_rows: int | None = None
) -> ProfileResult:
    """Run a pandas function per group.

    A group has to fit one task. With ``max_group_rows`` the sizes are checked first, and
    a larger group is an error, with its key.
    """
    keys = as_list(keys)
    require_columns(df, keys=keys)
    large = max_group_rows and df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > max_group_rows).limit(3).collect()
    if large:
        raise ValueError(f"groups too large for one task: {[r.asDict() for r in large]}")
    return ProfileResult(df.groupBy(*keys).applyInPandas(fn, schema))
