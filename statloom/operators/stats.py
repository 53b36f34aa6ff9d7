"""Correlations, analysis of variance and the chi-square test."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import chi2_tail_col, f_tail_col, t_two_sided, t_two_sided_col
from statloom.functions.missing import all_present, number
from statloom.functions.ordered import average_ranks
from statloom.functions.totals import attach_totals
from statloom.result import ProfileResult, as_list, numeric_features, quoted, require_columns, require_count, require_rows

METHODS = ("pearson", "spearman", "mutual_info")
MAX_PAIR_EXPRESSIONS = 435
MI_BINS = 16


def _pairs(features: list[str], target: str | None) -> list[tuple[str, str]]:
    if target:
        return [(c, target) for c in features if c != target]
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]


def _correlate(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[int, list[float | None]]:
    """Row count and correlation of each pair, all in one pass over the complete rows."""
    if len(pairs) <= MAX_PAIR_EXPRESSIONS:
        aggs = [F.corr(F.col(quoted(a)), F.col(quoted(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
        row = df.agg(F.count("*").alias("n"), *aggs).first()
        return row["n"], [row[f"r{i}"] for i in range(len(pairs))]
    names = sorted({c for p in pairs for c in p})
    vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(df).select("_v")
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    at = {c: i for i, c in enumerate(names)}
    return df.count(), [float(matrix[at[a], at[b]]) for a, b in pairs]


def _bin(c: Column, edges: list[float]) -> Column:
    """Index of the bin: how many edges lie below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (c > F.lit(float(e))).cast("int")
    return out


def _mutual_information(
    df: DataFrame, features: list[str], ref: str, edges: dict[str, list[float]] | None
) -> tuple[int, dict[str, float]]:
    """Mutual information of binned values, in nats.

    Every row becomes one (feature, bin, reference bin) record per feature, which the
    partial aggregation folds to at most bins² records per feature and task.
    """
    cols = [*features, ref]
    if edges is None:
        probs = [i / MI_BINS for i in range(1, MI_BINS)]
        row = df.agg(*[F.percentile_approx(quoted(c), probs, 10000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
        edges = {c: sorted(set(row[f"q{i}"] or [])) for i, c in enumerate(cols)}
    bins = F.array(
        *[F.struct(F.lit(c).alias("feature"), _bin(F.col(quoted(c)), edges[c]).alias("bx")) for c in features]
    )
    joint = (
        df.select(_bin(F.col(quoted(ref)), edges[ref]).alias("by"), F.explode(bins).alias("b"))
        .groupBy("b.feature", "b.bx", "by")
        .agg(F.count("*").alias("n"))
        .collect()  # at most bins² rows per feature
    )
    out = {}
    for c in features:
        cells = [(r["bx"], r["by"], r["n"]) for r in joint if r["feature"] == c]
        total = sum(n for *_, n in cells)
        px, py = {}, {}
        for x, y, n in cells:
            px[x] = px.get(x, 0) + n
            py[y] = py.get(y, 0) + n
        out[c] = max(0.0, sum(n / total * math.log(n * total / (px[x] * py[y])) for x, y, n in cells))
    total_rows = sum(r["n"] for r in joint if r["feature"] == features[0])
    return total_rows, out


def correlations(
    df: DataFrame,
    features: list[str] | None = None,
    target: str | None = None,
    method: str = "pearson",
    top_n: int | None = None,
    bin_edges: dict[str, list[float]] | None = None,
) -> ProfileResult:
    """Ranked correlations of feature pairs, or of features with a target, on complete rows.

    All pairs come back unless ``top_n`` asks for the strongest only.

    Spearman runs the same formula on average ranks. Mutual information is estimated on
    quantile bins (or the given edges), not by nearest neighbours.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    given = as_list(features)
    features = given or numeric_features(df, [target] if target else [])
    require_columns(df, features=features, **({"target": target} if target else {}))
    if len(features) < 2:
        raise ValueError("need at least 2 feature columns for correlation analysis")
    cols = list(dict.fromkeys(features + ([target] if target else [])))
    work = df.select([number(df, c).alias(c) for c in cols]).dropna()
    if method == "mutual_info":
        bad = [c for c in cols if c not in numeric_features(df)]
        if bad:
            raise ValueError(f"mutual_info requires numeric features; non-numeric columns: {bad}")
        ref = target or features[0]
        others = [c for c in features if c != ref]
        n, scores = _mutual_information(work, others, ref, bin_edges)
        found = [(c, ref, scores[c], None) for c in others]
    else:
        if method == "spearman":
            values = work
            for c in cols:
                ranks = average_ranks(values.select(c), c, rank=f"_r_{c}").select(c, f"_r_{c}")
                work = work.join(ranks, c)
            work = work.select([F.col(f"_r_{c}").alias(c) for c in cols])
        pairs = _pairs(features, target)
        n, values = _correlate(work, pairs)
        found = []
        for (a, b), r in zip(pairs, values):
            if r is None or math.isnan(r):
                continue
            t = math.inf if abs(r) >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
            found.append((a, b, float(r), t_two_sided(t, n - 2)))
    require_count(n, 10, "correlation analysis")
    found.sort(key=lambda x: -abs(x[2]))
    top = [(*row, i) for i, row in enumerate(found[:top_n], start=1)]
    spark = df.sparkSession
    schema = "feature_a string, feature_b string, correlation double, p_value double, rank int"
    metrics = spark.createDataFrame(
        [(method, n, len(found), top_n)], "method string, rows_used long, pairs_computed int, top_n int"
    )
    return ProfileResult(spark.createDataFrame(top, schema), {}, metrics)


def anova(
    df: DataFrame,
    metric_column: str,
    group_column: str,
    alpha: float = 0.05,
    second_group_column: str | None = None,
) -> ProfileResult:
    """One-way analysis of variance from the per-group counts, means and variances.

    Everything after the grouped aggregate works on one row per group. Pairwise
    comparisons are Welch t-tests with Bonferroni correction.
    """
    require_columns(df, metric_column=metric_column, group_column=group_column)
    needed = [metric_column, group_column, *as_list(second_group_column)]
    require_columns(df, columns=needed)
    work = df.filter(all_present(df, needed)).select(
        F.col(quoted(group_column)).alias("group"), number(df, metric_column).alias("x")
    )
    require_rows(work, 10, "analysis of variance")
    if work.filter(F.col("group") != F.lit(work.first()["group"])).isEmpty():
        raise ValueError(f"{group_column} has one group only; analysis of variance compares two or more")
    summary = work.groupBy("group").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("_v")
    )
    totals = summary.agg(
        F.sum("n").alias("_total"),
        F.count("*").alias("_k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"),
    )
    spread = attach_totals(summary, totals).agg(
        F.max("_total").alias("rows_used"),
        F.max("_k").alias("n_groups"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("_v"), F.lit(0.0))).alias("ss_within"),
    )
    d1, d2 = F.col("n_groups") - 1, F.col("rows_used") - F.col("n_groups")
    ratio = F.try_divide(F.col("ss_between") / d1, F.col("ss_within") / d2)
    table = (
        spread.filter("rows_used >= 10 and n_groups >= 2")
        .withColumn("f_statistic", ratio)
        .withColumn("p_value", f_tail_col("f_statistic", d1.cast("double"), d2.cast("double")))
        .withColumn(
            "eta_squared",
            F.coalesce(F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")), F.lit(0.0)),
        )
        .select(
            "n_groups",
            "rows_used",
            F.round("f_statistic", 4).alias("f_statistic"),
            F.round("p_value", 6).alias("p_value"),
            F.round("eta_squared", 4).alias("eta_squared"),
            (F.col("p_value") < alpha).alias("significant"),
            F.lit(alpha).alias("alpha"),
        )
    )
    # one output row per pair of groups; the inputs are one row per group
    a = attach_totals(summary, totals).alias("a")
    b = summary.alias("b")
    va, vb = F.col("a._v") / F.col("a.n"), F.col("b._v") / F.col("b.n")
    dof = F.try_divide(
        F.pow(va + vb, 2), F.pow(va, 2) / (F.col("a.n") - 1) + F.pow(vb, 2) / (F.col("b.n") - 1)
    )
    comparisons = F.col("_k") * (F.col("_k") - 1) / 2
    pairwise = (
        a.join(b, F.col("a.group") < F.col("b.group"))
        .select(
            F.col("a.group").cast("string").alias("group1"),
            F.col("b.group").cast("string").alias("group2"),
            (F.col("a.mean") - F.col("b.mean")).alias("mean_diff"),
            F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb)).alias("t_statistic"),
            dof.alias("degrees_of_freedom"),
            comparisons.alias("_m"),
        )
        .withColumn("_p", t_two_sided_col("t_statistic", "degrees_of_freedom") * F.col("_m"))
        .withColumn("_p", F.when(F.col("_p") > 1, F.lit(1.0)).otherwise(F.col("_p")))
        .withColumn("p_value", F.round("_p", 6))
        .withColumn("significant", F.col("_p") < alpha)
        .drop("_m", "_p")
    )
    tables = {"group_summary": summary.drop("_v"), "anova_table": table, "pairwise": pairwise}
    return ProfileResult(df, tables, table)


def chi_square(
    df: DataFrame, row_column: str, col_column: str, weight_column: str | None = None, alpha: float = 0.05
) -> ProfileResult:
    """Chi-square test of independence with Cramér's V; 2×2 tables get Yates' correction.

    The contingency table is kept in long form, with a row for every combination of the
    two margins.
    """
    require_columns(df, row_column=row_column, col_column=col_column)
    needed = [row_column, col_column, *as_list(weight_column)]
    require_columns(df, columns=needed)
    weight = number(df, weight_column) if weight_column else F.lit(1.0)
    work = df.filter(all_present(df, needed)).select(
        F.col(quoted(row_column)).alias("row_value"), F.col(quoted(col_column)).alias("col_value"), weight.alias("w")
    )
    require_rows(work, 5, "a chi-square test")
    cells = work.groupBy("row_value", "col_value").agg(F.sum("w").alias("observed"))
    by_row = cells.groupBy("row_value").agg(F.sum("observed").alias("_r"))
    by_col = cells.groupBy("col_value").agg(F.sum("observed").alias("_c"))
    totals = cells.agg(F.sum("observed").alias("_n"))
    inverse = lambda c: F.sum(F.try_divide(F.lit(1.0), F.col(c)))
    shape = by_row.agg(F.count("*").alias("_nr"), inverse("_r").alias("_ir")).crossJoin(
        by_col.agg(F.count("*").alias("_nc"), inverse("_c").alias("_ic"))
    )  # one row each
    # every combination of the margins is a cell of the result
    grid = by_row.crossJoin(by_col).join(cells, ["row_value", "col_value"], "left")
    full = attach_totals(attach_totals(grid, totals), shape).withColumns(
        {
            "observed": F.coalesce(F.col("observed"), F.lit(0.0)),
            "expected": F.try_divide(F.col("_r") * F.col("_c"), F.col("_n")),
        }
    )
    # the statistic needs the observed cells only: an empty cell adds its expected count, and
    # the four cells of a 2×2 table are all off by the same amount
    seen = attach_totals(attach_totals(cells.join(by_row, "row_value").join(by_col, "col_value"), totals), shape)
    seen = seen.withColumn("expected", F.try_divide(F.col("_r") * F.col("_c"), F.col("_n")))
    gap = F.abs(F.col("observed") - F.col("expected"))
    two_by_two = (F.max("_nr") == 2) & (F.max("_nc") == 2)
    off = F.max(gap)
    corrected = off - F.least(off, F.lit(0.5))
    plain = F.sum(F.try_divide(gap * gap, F.col("expected"))) + (F.max("_n") - F.sum("expected"))
    chi2 = F.when(two_by_two, corrected * corrected * F.max("_n") * F.max("_ir") * F.max("_ic")).otherwise(plain)
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("_nr", "_nc") - 1)))
    test = (
        seen.agg(
            F.max("_nr").alias("_nr"),
            F.max("_nc").alias("_nc"),
            F.floor(F.max("_n")).alias("n"),
            chi2.alias("chi2"),
        )
        .withColumn("degrees_of_freedom", (F.col("_nr") - 1) * (F.col("_nc") - 1))
        .withColumn("p_value", chi2_tail_col("chi2", F.col("degrees_of_freedom").cast("double")))
        .withColumn("cramers_v", F.coalesce(v, F.lit(0.0)))
    )
    effect = (
        F.when(F.col("cramers_v") < 0.1, "negligible")
        .when(F.col("cramers_v") < 0.3, "small")
        .when(F.col("cramers_v") < 0.5, "medium")
        .otherwise("large")
    )
    statistics = test.select(
        "n",
        F.round("chi2", 4).alias("chi2_statistic"),
        F.round("p_value", 6).alias("p_value"),
        "degrees_of_freedom",
        (F.col("p_value") < alpha).alias("significant"),
        F.lit(alpha).alias("alpha"),
        F.round("cramers_v", 4).alias("cramers_v"),
        effect.alias("effect_size"),
    )
    tables = {
        "observed": full.select("row_value", "col_value", "observed"),
        "expected": full.select("row_value", "col_value", "expected"),
        "test_statistics": statistics,
    }
    return ProfileResult(df, tables, statistics)


def contingency_wide(table: DataFrame, value: str, columns: list | None = None) -> DataFrame:
    """The long contingency table with one column per value of the second variable."""
    return table.groupBy("row_value").pivot("col_value", columns).agg(F.first(value))
