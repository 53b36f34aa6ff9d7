"""Attaching the one row of a global aggregate, or a few counted rows, to every row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage

# Rows that may be sent to every task.
FEW_ROWS = 100_000


def attach_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals`` is the result of an aggregate without keys: exactly one row."""
    return df.crossJoin(F.broadcast(totals))


def few_or_joined(df: DataFrame) -> DataFrame:
    """The written table, marked for broadcast where it has few rows.

    A plain join by a key of a few values sends all rows of the other side to as many
    tasks: adaptive execution turns no side with mostly empty partitions into a broadcast.
    """
    written = cut_lineage(df)
    return F.broadcast(written) if written.count() <= FEW_ROWS else written
