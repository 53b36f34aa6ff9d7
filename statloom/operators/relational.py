"""Joins and transforms, composition of operators, and snapshot comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import all_present, number
from statloom.functions.ordered import exact_quantile
from statloom.functions.totals import few_or_joined
from statloom.result import ProfileResult, as_list, quoted, require_columns

JOIN_TYPES = ("inner", "left", "right", "full")


def multi_join(
    df: DataFrame,
    others: list[DataFrame],
    join_keys: list[str],
    join_type: str = "left",
    filter_expression: str = "",
    select_columns: list[str] | None = None,
) -> ProfileResult:
    """Fold equi-joins of further datasets onto ``df``, then filter and project.

    Columns of the i-th dataset that are no join keys become ``src{i}_{column}``. The
    whole chain is one plan: the filter sinks below the joins where the join type allows,
    unused columns are pruned from the scans, and adaptive execution turns a side measured
    as small into a broadcast and splits skewed join partitions.
    """
    keys = as_list(join_keys)
    if not keys:
        raise ValueError("join_keys must name at least one column")
    if join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {JOIN_TYPES}")
    require_columns(df, join_keys=keys)
    joined = df
    for i, right in enumerate(others, start=1):
        require_columns(right, join_keys=keys)
        renamed = right.select(
            [F.col(quoted(c)) if c in keys else F.col(quoted(c)).alias(f"src{i}_{c}") for c in right.columns]
        )
        joined = joined.join(renamed, on=keys, how=join_type)
    if filter_expression.strip():
        joined = joined.filter(filter_expression)
    if select_columns:
        joined = joined.select(*[quoted(c) for c in select_columns])
    metrics = joined.agg(F.count("*").alias("row_count")).withColumns(
        {
            "column_count": F.lit(len(joined.columns)),
            "additional_sources": F.lit(len(others)),
            "join_type": F.lit(join_type),
        }
    )
    return ProfileResult(joined, {}, metrics)


def chain(df: DataFrame, *steps: Callable[[DataFrame], ProfileResult], costs: list[float] = ()) -> ProfileResult:
    """Feed the rows of each step to the next one, without writing in between.

    Each step carries its own parameters. Tables and metrics are those of the last step;
    with ``costs`` the summed cost and the number of steps come along as a table.
    """
    if not steps:
        raise ValueError("chain needs at least one step")
    result = steps[0](df)
    for step in steps[1:]:
        result = step(result.rows)
    if costs:
        summary = df.sparkSession.createDataFrame(
            [(len(steps), float(sum(costs)))], "steps int, total_cost double"
        )
        result.tables["chain"] = summary
    return result


def run_many(
    df: DataFrame,
    operators: dict[str, Callable[[DataFrame], ProfileResult]],
    requested: list[str] | None = None,
    limit: int | None = None,
) -> tuple[dict[str, ProfileResult], dict[str, str], DataFrame]:
    """Run several operators on one input; returns results, errors and the shared input.

    The input is persisted (spilling to disk) so that it is scanned once; the caller
    unpersists the third item when all results have been used.
    """
    wanted = list(operators) if requested is None else list(requested)
    if limit is not None and len(wanted) > limit:
        raise ValueError(f"at most {limit} operators per run")
    shared = df.persist(StorageLevel.MEMORY_AND_DISK)
    results, errors = {}, {}
    for name in wanted:
        if name not in operators:
            errors[name] = f"unknown operator '{name}'; available: {sorted(operators)}"
            continue
        try:
            results[name] = operators[name](shared)
        except ValueError as exc:
            errors[name] = str(exc)
    return results, errors, shared


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns only in A or only in B and columns whose type changed, with the values they hold on each side."""
    ta = {f.name: f.dataType.simpleString() for f in a.schema}
    tb = {f.name: f.dataType.simpleString() for f in b.schema}
    rows = [(c, "only_in_a", ta[c], None) for c in sorted(set(ta) - set(tb))]
    rows += [(c, "only_in_b", None, tb[c]) for c in sorted(set(tb) - set(ta))]
    rows += [(c, "type_change", ta[c], tb[c]) for c in sorted(set(ta) & set(tb)) if ta[c] != tb[c]]
    changes = a.sparkSession.createDataFrame(rows, "column string, change string, type_a string, type_b string")
    for df, types, n in ((a, ta, "values_a"), (b, tb, "values_b")):
        held = [r[0] for r in rows if r[0] in types]
        if not held:
            changes = changes.withColumn(n, F.lit(None).cast("long"))
            continue
        # one pass per side, one row per changed column
        counts = df.agg(*[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(held)])
        listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias(n)) for i, c in enumerate(held)])
        changes = changes.join(counts.select(F.inline(listed)), "column", "left")
    return changes


def snapshot_diff(a: DataFrame, b: DataFrame, multiset: bool = False) -> ProfileResult:
    """Rows added, removed and unchanged between two snapshots, on their common columns.

    One grouped pass over both sides: equal rows meet in one group after partial
    aggregation, so a row copied any number of times costs one row in the shuffle. Rows
    are compared as sets; ``multiset=True`` counts surplus copies.
    """
    common = sorted(set(a.columns) & set(b.columns))
    tables = {"schema_diff": schema_diff(a, b)}
    if not common:
        na, nb = a.agg(F.count("*").alias("removed")), b.agg(F.count("*").alias("added"))
        counts = nb.crossJoin(na).withColumn("unchanged", F.lit(0).cast("long"))  # one row each
        empty = a.sparkSession.createDataFrame([], "change string, copies long")
        return ProfileResult(empty, tables, counts)
    cols = [F.col(quoted(c)) for c in common]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = a.select(*cols, one.alias("_a"), zero.alias("_b")).unionByName(
        b.select(*cols, zero.alias("_a"), one.alias("_b"))
    )
    counts = both.groupBy(*cols).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if multiset:
        parts = F.array(
            F.struct(F.lit("added").alias("change"), F.greatest(F.col("_b") - F.col("_a"), zero).alias("copies")),
            F.struct(F.lit("removed").alias("change"), F.greatest(F.col("_a") - F.col("_b"), zero).alias("copies")),
            F.struct(F.lit("unchanged").alias("change"), F.least("_a", "_b").alias("copies")),
        )
        rows = counts.select(*cols, F.inline(parts)).filter("copies > 0")
    else:
        change = (
            F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").otherwise("unchanged")
        )
        rows = counts.select(*cols, change.alias("change"), one.alias("copies"))
    tally = lambda kind: F.coalesce(F.sum(F.when(F.col("change") == kind, F.col("copies"))), zero).alias(kind)
    metrics = rows.agg(*[tally(k) for k in ("added", "removed", "unchanged")])
    return ProfileResult(rows, tables, metrics)


def standardize(df: DataFrame, columns: list[str], suffix: str = "_scaled") -> DataFrame:
    """z-scores with the population deviation; a constant column is only centred."""
    require_columns(df, columns=columns)
    stats = df.agg(
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return df.withColumns(
        {
            f"{c}{suffix}": (number(df, c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        }
    )


def train_test_flag(
    df: DataFrame, id_columns: list[str], test_size: float = 0.2, seed: int = 42, flag: str = "is_test", stratify: str | None = None
) -> DataFrame:
    """Mark a deterministic share of rows as test rows.

    The mark depends on the row's id and the seed alone, so it survives retries and
    repartitioning. With ``stratify`` every class keeps the share, by the exact quantile of
    its rows' marks: a class of one row has it for training. Rows without a class are not
    test rows.
    """
    require_columns(df, id_columns=id_columns, stratify=stratify) if stratify else require_columns(df, id_columns=id_columns)
    mark = F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in as_list(id_columns)])
    if stratify is None:
        return df.withColumn(flag, F.pmod(mark, F.lit(1_000_000)) < int(test_size * 1_000_000))
    share = F.pmod(mark, F.lit(1 << 52))  # exact as a double
    marks = df.select(F.col(quoted(stratify)).alias("_class"), share.alias("_mark")).filter("_class IS NOT NULL")
    limits = few_or_joined(exact_quantile(marks, "_mark", ["_class"], test_size, "_limit"))
    joined = df.withColumn("_mark", share).join(limits, F.col(quoted(stratify)) == F.col("_class"), "left")
    return joined.withColumn(flag, F.coalesce(F.col("_mark") < F.col("_limit"), F.lit(False))).drop("_mark", "_class", "_limit")


def excluded_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows used and rows left out because a named column is missing."""
    ok = all_present(df, columns)
    return df.agg(F.count_if(ok).alias("rows_used"), F.count_if(~ok).alias("rows_excluded"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
