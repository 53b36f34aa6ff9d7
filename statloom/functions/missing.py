"""Missing values: NaN and NULL count as one thing, grouping drops NULL keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.result import quoted


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number, and NaN, become NULL."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    c = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(c), c)


def moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that is no date becomes NULL."""
    kind = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(kind, T.StringType):
        return c.try_cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, independent of the session zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (c.cast("timestamp_ntz") - origin).cast("interval second").cast("decimal(20,6)").cast("double")


def all_present(df: DataFrame, names: list[str]) -> Column:
    """True where none of the columns is missing."""
    return reduce(lambda a, b: a & b, [clean(df, n).isNotNull() for n in names])


def complete_cases(df: DataFrame, names: list[str], flag: str = "is_complete") -> DataFrame:
    """Flag rows without a missing value in the named columns.

    Models fit on the flagged rows and score with ``when(flag, …)``, so incomplete rows
    keep their place in the output with NULL result columns and no join back is needed.
    """
    return df.withColumn(flag, all_present(df, names))
