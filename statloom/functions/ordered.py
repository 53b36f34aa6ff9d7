"""Ordered computations per key that no single task has to hold.

``Window.partitionBy(key)`` sends all rows of a key to one task, which fails when one key
holds a third of the table. The helpers here cut the order axis into buckets at
quantiles, compute inside (key, bucket) and carry one summary row per (key, bucket)
across: the carry is the only part that looks at a whole key, and it has at most one
row per bucket.

Ranks and percentiles first collapse equal values to counts, so ties of any size stay
one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.missing import epoch_seconds
from statloom.functions.totals import attach_totals, few_or_joined
from statloom.session import cut_lineage

ROWS_PER_BUCKET = 2_000_000
COARSE_GRID = 1024
FINE_GRID = 16384
SAMPLE_PER_BUCKET = 16
BUCKET = "_bucket"
_AXIS = "_axis"


def order_axis(df: DataFrame, name: str) -> Column | None:
    """A numeric or date column as a double that sorts the same way; None for other types."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType) or not isinstance(kind, (T.NumericType, T.DateType, T.TimestampNTZType, T.TimestampType)):
        return None
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(name)) / F.lit(1e6)
    return epoch_seconds(F.col(name))


@dataclass
class Cuts:
    """Bucket edges on the first order column, and finer ones for its heaviest values.

    ``inner`` holds one row: edges of the order columns in ``within``, in two levels. With
    a first column that is no number or date there are no ``edges``, and ``inner`` cuts all
    rows.
    """

    edges: list[float]
    heavy: list[float]
    within: list[str]
    inner: DataFrame | None

    @property
    def single(self) -> bool:
        return not self.edges and self.inner is None


def _quantiles(df: DataFrame, axis: Column, rows_per_bucket: int) -> list[float]:
    """Quantiles of the axis, one per bucket edge, in one pass over the data.

    A value that comes back more than once fills a bucket by itself. Tables too large
    for the coarse grid take a second pass on the fine one.
    """
    for grid in (COARSE_GRID, FINE_GRID):
        probs = ", ".join(f"{i / grid}D" for i in range(1, grid))
        found = df.select(axis.alias(_AXIS)).agg(
            F.count("*").alias("n"), F.expr(f"percentile_approx({_AXIS}, array({probs}), {10 * grid})").alias("q")
        ).first()
        wanted = found["n"] // rows_per_bucket + 1
        if wanted <= 1 or not found["q"]:
            return []
        if wanted <= grid:
            break
    wanted = min(grid, wanted)
    return [found["q"][round(i * grid / wanted) - 1] for i in range(1, wanted)]


def _sampled_edges(df: DataFrame, columns: list[str], rows_per_bucket: int) -> DataFrame | None:
    """Edges for columns of any orderable types, from the rows with the smallest hashes.

    The sample is the same whatever the partitioning, and its size follows the number of
    buckets, at most ``FINE_GRID``. Edges come as one row with an array of edges and, for
    each of its gaps, the array of edges inside, so that a search looks at few of them.
    """
    wanted = min(FINE_GRID, df.count() // rows_per_bucket + 1)
    if wanted <= 1:
        return None
    # a column may hold few values per row of the table, so all columns enter the hash
    sampled = df.select(F.struct(*columns).alias("s"), F.xxhash64(*df.columns).alias("h")).orderBy("h").limit(SAMPLE_PER_BUCKET * wanted)
    rows = [r["s"] for r in sampled.orderBy("s").collect()]
    edges = list(dict.fromkeys(rows[len(rows) * i // wanted] for i in range(1, wanted)))
    step = max(1, round(len(edges) ** 0.5))
    nested = [edges[i : i + step] for i in range(0, len(edges), step)]
    kind = T.ArrayType(sampled.schema["s"].dataType)
    schema = T.StructType([T.StructField("_cut_first", kind), T.StructField("_cut_groups", T.ArrayType(kind))])
    return df.sparkSession.createDataFrame([([g[0] for g in nested], nested)], schema)


def find_cuts(df: DataFrame, order: list[str], rows_per_bucket: int | None = None) -> Cuts:
    """Choose bucket edges: about ``rows_per_bucket`` rows each, at most ``FINE_GRID`` buckets.

    Only the edges reach the driver. Values so frequent that they fill a bucket are cut
    further along the other order columns.
    """
    size = rows_per_bucket or ROWS_PER_BUCKET
    axis = order_axis(df, order[0])
    if axis is None:
        return Cuts([], [], order, _sampled_edges(df, order, size))
    edges = _quantiles(df, axis, size)
    heavy = sorted({e for e in edges if edges.count(e) > 1})
    inner = _sampled_edges(df.filter(axis.isin(heavy)), order[1:], size) if heavy and order[1:] else None
    return Cuts(sorted(set(edges)), heavy, order[1:], inner)


def _cut(df: DataFrame, axis: str, edges: list[float], out: str) -> DataFrame:
    splits = [float("-inf"), *edges, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=axis, outputCol=out, handleInvalid="keep").transform(df)


def _place(place: Column) -> Column:
    """How many edges a row reaches, by the two levels of ``_sampled_edges``."""
    reached = lambda edges: F.size(F.filter(edges, lambda e: place >= e))
    group = F.greatest(reached(F.col("_cut_first")) - 1, F.lit(0))
    step = F.size(F.get("_cut_groups", F.lit(0)))
    return (group * step + reached(F.get("_cut_groups", group))).cast("long")


def with_buckets(df: DataFrame, order: list[str], cuts: Cuts) -> DataFrame:
    """Add a bucket number that grows with the order columns."""
    if cuts.single:
        return df.withColumn(BUCKET, F.lit(0).cast("long"))
    axis = order_axis(df, order[0])
    if axis is None:
        return attach_totals(df, cuts.inner).withColumn(BUCKET, _place(F.struct(*cuts.within))).drop("_cut_first", "_cut_groups")
    out = _cut(df.withColumn(_AXIS, axis), _AXIS, cuts.edges, "_b1")
    fine = F.lit(0)
    if cuts.inner is not None:
        out = attach_totals(out, cuts.inner)
        # rows that equal the lower edge of their bucket come first in it
        fine = F.when(F.col(_AXIS).isin(cuts.heavy), _place(F.struct(*cuts.within))).otherwise(F.lit(FINE_GRID))
    bucket = F.col("_b1").cast("long") * (FINE_GRID + 1) + fine
    # missing values sort first
    return out.withColumn(BUCKET, F.when(F.col(_AXIS).isNull(), -1).otherwise(bucket)).drop(_AXIS, "_b1", "_cut_first", "_cut_groups")


def _carry_in(cut: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Join the per-bucket carry; null-safe on the keys, a missing key is a key of its own."""
    renamed = carry.withColumnsRenamed({**{k: f"_k_{i}" for i, k in enumerate(keys)}, BUCKET: "_k_bucket"})
    on = F.col(BUCKET) == F.col("_k_bucket")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return cut.join(renamed, on, "left")


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    inclusive: bool = True,
    rows_per_bucket: int | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add running totals per key along the order columns.

    ``order`` must be unique per key for a deterministic result. With ``inclusive=False``
    the total stops before the row.
    """
    cuts = cuts or find_cuts(df, order, rows_per_bucket)
    staged = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()})
    cut = with_buckets(staged, order, cuts)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = {n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
    if cuts.single:  # the whole table fits one bucket
        return cut.withColumns(local).select(*df.columns, *sums)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, BUCKET).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carry = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    out = _carry_in(cut, carry, keys).withColumns({n: local[n] + F.col(f"_c_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    rows_per_bucket: int | None = None,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add values of the previous row of the same key (NULL on the first row)."""
    cuts = cuts or find_cuts(df, order, rows_per_bucket)
    cut = with_buckets(df, order, cuts)
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    picked = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    found = F.lag(picked).over(inside)
    if not cuts.single:
        across = Window.partitionBy(*keys).orderBy(BUCKET)
        last = cut.groupBy(*keys, BUCKET).agg(F.max_by(picked, F.struct(*order)).alias("_last"))
        cut = _carry_in(cut, last.select(*keys, BUCKET, F.lag("_last").over(across).alias("_carry")), keys)
        found = F.coalesce(found, F.col("_carry"))
    return cut.withColumn("_prev", found).select(*df.columns, *[F.col(f"_prev.{o}").alias(o) for o in values])


def value_counts(
    df: DataFrame, keys: list[str], value: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """One row per (key, distinct value): count ``n``, rows before it ``below``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_sums(counts, keys, [value], {"below": F.col("n")}, inclusive=False, rows_per_bucket=rows_per_bucket)


def average_ranks(
    df: DataFrame, value: str, keys: list[str] = (), rank: str = "avg_rank", rows_per_bucket: int | None = None
) -> DataFrame:
    """One row per (key, distinct value) with its count and average rank (ties averaged)."""
    vc = value_counts(df, list(keys), value, rows_per_bucket)
    return vc.withColumn(rank, F.col("below") + (F.col("n") + 1) / F.lit(2.0))


def exact_quantile(
    df: DataFrame,
    value: str,
    keys: list[str] = (),
    q: float = 0.5,
    out: str = "quantile",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Exact interpolated quantile per key, from value counts instead of one buffer per key.

    The two order statistics around ``(n-1)q`` are found among the counted values.
    """
    keys = list(keys)
    vc = value_counts(df, keys, value, rows_per_bucket)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    if keys:
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        joined = vc.alias("a").join(few_or_joined(sizes).alias("s"), on)
    else:
        joined = vc.alias("a").crossJoin(F.broadcast(sizes.alias("s")))  # one row
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)
    holds = lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("n"))
    picked = joined.filter(holds(lo) | holds(hi)).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(
        F.max(F.when(holds(lo), F.col(value).cast("double"))).alias("_lo"),
        F.max(F.when(holds(hi), F.col(value).cast("double"))).alias("_hi"),
        F.max(pos - lo).alias("_f"),
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def numbered(labels: DataFrame, column: str, out: str) -> DataFrame:
    """Dense number per distinct label, 0-based in label order, without a global window.

    Labels are range-partitioned; only one row count per partition reaches the driver.
    """
    spread = cut_lineage(
        labels.select(column).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    )
    start, offsets = 0, []
    for r in spread.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], start))
        start += r["n"]
    base = labels.sparkSession.createDataFrame(offsets, "_part int, _base long")  # one row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return spread.join(F.broadcast(base), "_part").select(column, (local + F.col("_base")).alias(out))
