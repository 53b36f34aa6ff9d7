"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """(k, y): at most ``per_label`` keys of each label 0 and 1.

    Keys are dealt into ``per_label`` slots by a hash, and each slot keeps the key with the
    smallest second hash: the same answer whatever the order and partitioning. Rows without
    key or with another label, and keys with both labels, are left out.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
    single = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z")
    keyed = single.select("y", F.pmod(F.xxhash64("k"), F.lit(per_label)).alias("slot"), F.struct(F.xxhash64("k", F.lit(1)).alias("h"), "k").alias("m"))
    return keyed.groupBy("y", "slot").agg(F.min("m").alias("m")).select(F.col("m.k").alias("k"), "y")
