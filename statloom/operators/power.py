"""Effect sizes, required sample sizes and power curves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.dist import normal_cdf_col, normal_quantile, t_two_sided
from statloom.functions.missing import clean, number
from statloom.functions.ordered import value_counts
from statloom.functions.totals import attach_totals
from statloom.result import ProfileResult, as_list, require_columns

CURVE_START, CURVE_END = 2, 100
LITERATURE_SHARE = 0.25


def effect_sizes(df: DataFrame, outcomes: list[str], treatments: list[str]) -> DataFrame:
    """Cohen's d between the first two groups of every (outcome, treatment) pair.

    All pairs come from one grouped aggregate over (outcome, treatment, group).
    """
    outcomes, treatments = as_list(outcomes), as_list(treatments)
    require_columns(df, outcome_var=outcomes, treatment_vars=treatments)
    pairs = F.array(
        *[
            F.struct(
                F.lit(o).alias("outcome"), F.lit(t).alias("treatment"), clean(df, t).cast("string").alias("grp"), number(df, o).alias("y")
            )
            for o in outcomes
            for t in treatments
        ]
    )
    groups = (
        df.select(F.inline(pairs))
        .filter("grp is not null and y is not null")
        .groupBy("outcome", "treatment", "grp")
        .agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v"))
    )
    packed = groups.select("outcome", "treatment", F.struct("grp", "n", "m", "v").alias("g"))
    first = packed.groupBy("outcome", "treatment").agg(F.min("g").alias("a"))
    second = (
        packed.join(first, ["outcome", "treatment"])
        .filter(F.col("g.grp") > F.col("a.grp"))
        .groupBy("outcome", "treatment", "a")
        .agg(F.min("g").alias("b"))
    )
    pooled = F.sqrt(
        F.try_divide(
            (F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v"), F.col("a.n") + F.col("b.n") - 2
        )
    )
    usable = (F.col("a.n") >= 2) & (F.col("b.n") >= 2) & (F.col("pooled_std") >= 1e-12)
    return (
        second.withColumn("pooled_std", pooled)
        .select(
            "outcome",
            "treatment",
            F.col("a.grp").alias("group1"),
            F.col("b.grp").alias("group2"),
            "pooled_std",
            F.when(usable, F.abs(F.col("a.m") - F.col("b.m")) / F.col("pooled_std")).alias("effect_size"),
        )
    )


def literature_effect(studies: DataFrame, column: str = "effect_size", rows_per_bucket: int | None = None) -> DataFrame:
    """The conservative (lower quartile) effect: element ``max(0, ⌊n/4⌋ - 1)`` in order."""
    counted = value_counts(studies.select(number(studies, column).alias("effect_size")), [], "effect_size", rows_per_bucket)
    total = counted.agg(F.sum("n").alias("_total"))
    at = F.greatest(F.floor(F.col("_total") * LITERATURE_SHARE) - 1, F.lit(0))
    return attach_totals(counted, total).filter((F.col("below") <= at) & (at < F.col("below") + F.col("n"))).select("effect_size")


def required_n(effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Subjects per group in the normal approximation."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return F.ceil(F.lit(2.0) * F.pow(F.lit(z) / effect, F.lit(2.0)))


def t_critical(alpha: float, dof: float) -> float:
    """Two-sided critical value of the t distribution by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, dof) > alpha:
            low = mid
        else:
            high = mid
    return (low + high) / 2


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def t_test_power(effect: float, n: float, alpha: float) -> float:
    """Power of the two-sided two-sample t-test with n subjects per group.

    Integrates the normal tail over the distribution of the pooled deviation.
    """
    dof, shift = 2 * n - 2, effect * math.sqrt(n / 2)
    crit = t_critical(alpha, dof)
    spread = 10 / math.sqrt(2 * dof)
    lo, hi = max(1e-9, 1 - spread), 1 + spread
    s = (hi - lo) / 2 * _NODES + (hi + lo) / 2
    log_density = (
        math.log(2) + dof / 2 * math.log(dof / 2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2
    )
    tail = np.array([0.5 * math.erfc((crit * v - shift) / math.sqrt(2)) + 0.5 * math.erfc((crit * v + shift) / math.sqrt(2)) for v in s])
    return float(min(1.0, (hi - lo) / 2 * np.sum(_WEIGHTS * np.exp(log_density) * tail)))


def t_test_n(effect: float, alpha: float, power: float) -> int:
    low, high = 2, 4
    while t_test_power(effect, high, alpha) < power:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if t_test_power(effect, mid, alpha) >= power else (mid, high)
    return low if t_test_power(effect, low, alpha) >= power else high


def _exact_power(alpha: float):
    @F.pandas_udf(T.DoubleType())
    def exact(effect: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_test_power(float(d), float(k), alpha) for d, k in zip(effect, n)])

    return exact


def _exact_n(alpha: float, power: float):
    @F.pandas_udf(T.LongType())
    def exact(effect: pd.Series) -> pd.Series:
        return pd.Series([t_test_n(float(d), alpha, power) for d in effect])

    return exact


def power_analysis(
    effects: DataFrame, effect_column: str = "effect_size", alpha: float = 0.05, target_power: float = 0.8, exact: bool = False
) -> ProfileResult:
    """Required size per group and the power curve for n = 2…100, per effect size row.

    ``exact`` uses the two-sample t-test instead of the normal approximation.
    """
    require_columns(effects, effect_column=effect_column)
    usable = effects.filter(F.col(effect_column) > 0)
    d = F.col(effect_column)
    need = _exact_n(alpha, target_power)(d) if exact else required_n(d, alpha, target_power)
    rows = usable.withColumn("required_n_per_group", need.cast("long"))
    curve = usable.withColumn("n", F.explode(F.sequence(F.lit(CURVE_START), F.lit(CURVE_END))))
    if exact:
        power = _exact_power(alpha)(d, F.col("n").cast("double"))
    else:
        z = normal_quantile(1 - alpha / 2)
        power = normal_cdf_col(d / F.sqrt(F.lit(2.0) / F.col("n")) - F.lit(z))
    return ProfileResult(rows, {"power_curve": curve.withColumn("power", F.round(power, 6))})


def manual_effect(spark, value: float) -> DataFrame:
    if value <= 0:
        raise ValueError("effect size must be > 0")
    return spark.createDataFrame([(float(value),)], "effect_size double")
