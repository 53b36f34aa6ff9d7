"""Instrumental variables, regression discontinuity and difference-in-differences.

Each estimator reduces the table to sums in one or two aggregations; the small linear
algebra on those sums runs on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import normal_quantile, t_two_sided
from statloom.functions.missing import all_present, number
from statloom.functions.moments import linear, weighted_moments
from statloom.result import ProfileResult, as_list, quoted, require_columns, require_count

WEAK_INSTRUMENT_F = 10.0
BANDWIDTH_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5)
# Rule-of-thumb bandwidth: factor · deviation · n^(-1/5).
BANDWIDTH_CONSTANT = 2.702
NORMAL_95 = 1.96


def causal_iv(
    df: DataFrame, outcome_var: str, treatment_var: str, instrument_var: str, control_vars: list[str] | None = None
) -> ProfileResult:
    """Two-stage least squares with one instrument and robust standard errors.

    No intercept is added; pass a constant control column to have one. The first pass
    sums the cross-products, the second the squared residuals of both stages.
    """
    controls = as_list(control_vars)
    require_columns(df, outcome_var=outcome_var, treatment_var=treatment_var, instrument_var=instrument_var)
    needed = [outcome_var, treatment_var, instrument_var, *controls]
    require_columns(df, columns=needed)
    work = df.filter(all_present(df, needed)).select(
        number(df, outcome_var).alias("_y"),
        number(df, treatment_var).alias("_t"),
        number(df, instrument_var).alias("_z"),
        *[number(df, c).alias(f"_c{i}") for i, c in enumerate(controls)],
    )
    y, t, z = F.col("_y"), F.col("_t"), F.col("_z")
    exog = [F.col(f"_c{i}") for i in range(len(controls))]
    m = len(controls)
    # moments of (controls, instrument, treatment) against the outcome
    n, cross, with_y, _ = weighted_moments(work, [*exog, z, t], y)
    require_count(n, 50, "causal-iv")
    z_cols, x_cols = list(range(m + 1)), [*range(m), m + 1]
    zz, zx, zy = cross[np.ix_(z_cols, z_cols)], cross[np.ix_(z_cols, x_cols)], with_y[z_cols]
    first = np.linalg.pinv(zz) @ zx  # fitted regressors are Z·first
    beta = np.linalg.pinv(first.T @ zz @ first) @ (first.T @ zy)
    stage = first[:, -1]
    fitted = [linear(0.0, first[:, j], [*exog, z]) for j in range(m + 1)]
    residual = y - linear(0.0, beta, [*exog, t])
    stage_residual = t - linear(0.0, stage, [*exog, z])
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    zs = [*exog, z]
    row = work.agg(
        *[F.sum(residual * residual * fitted[i] * fitted[j]).alias(f"s{i}_{j}") for i, j in pairs],
        *[F.sum(stage_residual * stage_residual * zs[i] * zs[j]).alias(f"f{i}_{j}") for i, j in pairs],
        F.count_if((t == 1) & (z == 1)).alias("complied"),
        F.count_if(z == 1).alias("offered"),
    ).first()
    square = lambda p: np.array(
        [[row[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(m + 1)] for i in range(m + 1)], dtype=float
    )
    bread = np.linalg.pinv(first.T @ zz @ first)
    error = math.sqrt(max(float((bread @ square("s") @ bread)[-1, -1]), 0.0))
    stage_bread = np.linalg.pinv(zz)
    stage_variance = float((stage_bread @ square("f") @ stage_bread)[-1, -1])
    f_stat = float(stage[-1] ** 2 / stage_variance) if stage_variance > 0 else math.inf
    estimate, q = float(beta[-1]), normal_quantile(0.975)
    warning = None
    if f_stat < WEAK_INSTRUMENT_F:
        warning = f"Weak instrument: first-stage F-statistic is {f_stat:.2f} (threshold: 10)"
    result = df.sparkSession.createDataFrame(
        [(estimate, error, estimate - q * error, estimate + q * error, f_stat, row["complied"] / max(row["offered"], 1), warning, n)],
        "iv_estimate double, std_error double, ci_lower double, ci_upper double, first_stage_f_stat double, "
        "compliance_rate double, warning string, rows_used long",
    )
    return ProfileResult(result, {}, result)


def _side_means(y: Column, r: Column, cutoff: float, h: float, tag: str) -> list[Column]:
    above = (r >= cutoff) & (r <= cutoff + h)
    below = (r >= cutoff - h) & (r < cutoff)
    return [
        F.avg(F.when(above, y)).alias(f"{tag}a"),
        F.avg(F.when(below, y)).alias(f"{tag}b"),
        F.count_if(above).alias(f"{tag}na"),
        F.count_if(below).alias(f"{tag}nb"),
    ]


def causal_rd(
    df: DataFrame,
    outcome_var: str,
    running_var: str,
    cutoff: float,
    bandwidth: str | float = "optimal",
    rd_type: str = "sharp",
    treatment_var: str | None = None,
) -> ProfileResult:
    """Sharp or fuzzy regression discontinuity with bandwidth sensitivity and density test.

    One aggregation finds size, spread and range, a second one all window means, a third
    the histogram of the running variable (one row per filled bin).
    """
    require_columns(df, outcome_var=outcome_var, running_var=running_var)
    fuzzy = rd_type.lower() == "fuzzy"
    needed = [outcome_var, running_var]
    if fuzzy:
        require_columns(df, treatment_var=treatment_var)
        needed.append(treatment_var)
    cutoff = float(cutoff)
    work = df.filter(all_present(df, needed)).select(
        number(df, outcome_var).alias("_y"),
        number(df, running_var).alias("_r"),
        (number(df, treatment_var) if fuzzy else F.lit(0.0)).alias("_t"),
    )
    y, r = F.col("_y"), F.col("_r")
    base = work.agg(
        F.count("*").alias("n"), F.stddev_samp(r).alias("s"), F.min(r).alias("lo"), F.max(r).alias("hi")
    ).first()
    n = base["n"]
    require_count(n, 20, "causal-rd")
    h = BANDWIDTH_CONSTANT * base["s"] * n ** (-0.2) if bandwidth == "optimal" else float(bandwidth)
    inside = (r >= cutoff - h) & (r <= cutoff + h)
    over = r >= cutoff
    aggs = [c for i, f in enumerate(BANDWIDTH_FACTORS) for c in _side_means(y, r, cutoff, h * f, f"w{i}_")]
    for name, v in (("y", y), ("t", F.col("_t"))):
        aggs += [
            F.avg(F.when(inside & over, v)).alias(f"{name}1"),
            F.avg(F.when(inside & ~over, v)).alias(f"{name}0"),
        ]
    row = work.agg(*aggs).first()
    sensitivity = []
    for i, f in enumerate(BANDWIDTH_FACTORS):
        enough = row[f"w{i}_na"] >= 3 and row[f"w{i}_nb"] >= 3
        sensitivity.append((round(h * f, 4), row[f"w{i}_a"] - row[f"w{i}_b"] if enough else None))
    estimate = sensitivity[BANDWIDTH_FACTORS.index(1.0)][1]
    if estimate is None:
        raise ValueError("insufficient observations within bandwidth")
    if fuzzy:
        jump = row["t1"] - row["t0"]
        estimate = (row["y1"] - row["y0"]) / jump if jump else math.nan
    statistic, p, bins = _density_test(work, n, base["lo"], base["hi"], cutoff)
    spark = df.sparkSession
    result = spark.createDataFrame(
        [(float(estimate), round(h, 4), n, statistic, p, bool(p is not None and p < 0.05))],
        "late_estimate double, bandwidth_used double, rows_used long, mccrary_statistic double, "
        "mccrary_pvalue double, manipulation_detected boolean",
    )
    tables = {
        "bandwidth_sensitivity": spark.createDataFrame(sensitivity, "bandwidth double, estimate double"),
        "histogram": bins,
    }
    return ProfileResult(result, tables, result)


def _density_test(work: DataFrame, n: int, low: float, high: float, cutoff: float):
    """t-test between the bin counts above and below the cutoff.

    Empty bins count too; their number on each side follows from the bin edges, so only
    filled bins are aggregated.
    """
    k = max(10, math.isqrt(n))
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / k
    position = F.least(F.floor((F.col("_r") - F.lit(low)) / F.lit(width)), F.lit(k - 1)).cast("long")
    bins = work.groupBy(position.alias("bin")).agg(F.count("*").alias("n"))
    center = F.lit(low) + (F.col("bin") + 0.5) * F.lit(width)
    above = F.col("center") >= F.lit(cutoff)
    bins = bins.withColumn("center", center)
    squared = F.pow(F.col("n").cast("double"), F.lit(2.0))
    row = bins.agg(
        F.coalesce(F.sum(F.when(above, F.col("n"))), F.lit(0)).alias("sa"),
        F.coalesce(F.sum(F.when(~above, F.col("n"))), F.lit(0)).alias("sb"),
        F.coalesce(F.sum(F.when(above, squared)), F.lit(0.0)).alias("qa"),
        F.coalesce(F.sum(F.when(~above, squared)), F.lit(0.0)).alias("qb"),
    ).first()
    kb = sum(1 for i in range(k) if low + (i + 0.5) * width < cutoff)  # k is about √n
    ka = k - kb
    if ka < 3 or kb < 3:
        return None, None, bins
    ma, mb = row["sa"] / ka, row["sb"] / kb
    pooled = ((row["qa"] - ka * ma * ma) + (row["qb"] - kb * mb * mb)) / (ka + kb - 2)
    spread = math.sqrt(max(pooled, 0.0) * (1 / ka + 1 / kb))
    t = (ma - mb) / spread if spread > 0 else math.nan
    return abs(ma - mb), t_two_sided(t, ka + kb - 2), bins


def _cell_sum(cells: dict, times: list, treated: int) -> tuple[int, float, float]:
    """Count, mean and population variance of several (time, treated) cells merged."""
    parts = [cells[(p, treated)] for p in times if (p, treated) in cells]
    n = sum(c[0] for c in parts)
    if n == 0:
        return 0, math.nan, math.nan
    mean = sum(c[0] * c[1] for c in parts) / n
    var = sum(c[0] * (c[2] + (c[1] - mean) ** 2) for c in parts) / n
    return n, mean, var


def _did(after, before) -> tuple[float, float, int]:
    """Difference of differences of four cells and its robust standard error."""
    (n11, m11, v11), (n10, m10, v10) = after
    (n01, m01, v01), (n00, m00, v00) = before
    if min(n11, n10, n01, n00) == 0:
        return math.nan, math.nan, n11 + n10 + n01 + n00
    return (
        (m11 - m01) - (m10 - m00),
        math.sqrt(v11 / n11 + v10 / n10 + v01 / n01 + v00 / n00),
        n11 + n10 + n01 + n00,
    )


def causal_did(
    df: DataFrame,
    outcome_var: str,
    treatment_group_var: str,
    time_var: str,
    pre_period: list,
    post_period: list,
) -> ProfileResult:
    """Difference-in-differences with parallel-trend check, event study and placebo tests.

    Every row whose time is not in ``post_period`` counts as before. The whole analysis
    derives from one grouped aggregate: count, mean and variance per (listed time,
    treated) cell, with all unlisted times in one cell.
    """
    require_columns(df, outcome_var=outcome_var, treatment_group_var=treatment_group_var, time_var=time_var)
    pre, post = as_list(pre_period), as_list(post_period)
    if not pre or not post:
        raise ValueError("name at least one period before and one after the treatment")
    listed = list(dict.fromkeys([str(p) for p in [*pre, *post]]))
    pre, post = [str(p) for p in pre], [str(p) for p in post]
    time = F.col(quoted(time_var)).cast("string")
    work = df.filter(all_present(df, [outcome_var, treatment_group_var])).select(
        number(df, outcome_var).alias("_y"),
        number(df, treatment_group_var).alias("_d"),
        F.when(time.isin(listed), time).alias("_p"),
    )
    grouped = (
        work.groupBy("_p", "_d")
        .agg(F.count("*").alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    )
    # at most (listed periods + 1) cells per treatment value, checked to be binary
    found = grouped.limit(2 * (len(listed) + 1) + 1).collect()
    if any(r["_d"] not in (0.0, 1.0) for r in found):
        raise ValueError("the treatment group column must be binary: 0 and 1")
    cells = {(r["_p"], int(r["_d"])): (r["n"], r["m"], r["v"]) for r in found}
    before = [p for p in [*listed, None] if p not in post]
    pair = lambda times: (_cell_sum(cells, times, 1), _cell_sum(cells, times, 0))
    estimate, error, used = _did(pair(post), pair(before))
    (n1, m1, v1), (n0, m0, v0) = pair(list(dict.fromkeys(pre)))
    trend_p = None
    if n1 + n0 >= 4 and n1 >= 2 and n0 >= 2:
        a, b = v1 / (n1 - 1), v0 / (n0 - 1)
        if a + b > 0:
            dof = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n0 - 1))
            trend_p = t_two_sided((m1 - m0) / math.sqrt(a + b), dof)
    base = pre[-1]
    events = []
    for p in sorted(listed):
        if p == base:
            events.append((p, 0.0, 0.0, 0.0, True))
            continue
        c, s, n = _did(pair([p]), pair([base]))
        if n >= 4 and not math.isnan(c):
            events.append((p, c, c - NORMAL_95 * s, c + NORMAL_95 * s, False))
    placebo = []
    for p in pre[:-1]:
        c, s, n = _did(pair([p]), pair([q for q in dict.fromkeys(pre) if q != p]))
        if not math.isnan(c):
            placebo.append((p, c, t_two_sided(c / max(s, 1e-10), max(n - 4, 1))))
    spark = df.sparkSession
    result = spark.createDataFrame(
        [(estimate, error, estimate - NORMAL_95 * error, estimate + NORMAL_95 * error, trend_p, used)],
        "did_estimate double, std_error double, ci_lower double, ci_upper double, "
        "parallel_trends_pvalue double, rows_used long",
    )
    tables = {
        "event_study": spark.createDataFrame(
            events, "period string, coefficient double, ci_lower double, ci_upper double, base boolean"
        ),
        "placebo": spark.createDataFrame(placebo, "period string, estimate double, p_value double"),
    }
    return ProfileResult(result, tables, result)
