"""Kaplan–Meier curves and the log-rank test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.dist import chi2_tail, normal_quantile
from statloom.functions.missing import clean, number
from statloom.functions.ordered import Cuts, find_cuts, running_sums
from statloom.result import ProfileResult, require_columns, require_count
from statloom.session import cut_lineage

MIN_GROUP = 5
# The log-rank system is solved when the squared remainder has shrunk by this factor.
SOLVED, MAX_ROUNDS = 1e-20, 1000


def _durations(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Valid rows as (group, timeline, event 0/1): missing or negative durations drop out."""
    observed = F.coalesce(number(df, event).cast("int") != 0, F.lit(False)).cast("long")
    return df.select(
        clean(df, group).alias("group"), number(df, duration).alias("timeline"), observed.alias("event")
    ).filter("timeline >= 0")


def _time_counts(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """Rows and events per (group, distinct time), written once: all else works on these."""
    valid = _durations(df, duration, event, group)
    return cut_lineage(valid.groupBy("group", "timeline").agg(F.count("*").alias("n"), F.sum("event").alias("events")))


def kaplan_meier(
    df: DataFrame,
    duration_column: str,
    event_column: str,
    group_column: str,
    confidence_level: float = 0.95,
    rows_per_bucket: int | None = None,
    log_rank: bool = True,
) -> ProfileResult:
    """Survival curves per group with exponential Greenwood bands, and the log-rank test unless ``log_rank`` is off.

    Rows collapse to one per (group, distinct time) first; all running totals work on
    those. Groups under five members are left out of the curves and listed.
    """
    if not 0 < confidence_level < 1:
        raise ValueError("confidence_level must be between 0 and 1 exclusive")
    require_columns(df, duration_column=duration_column, event_column=event_column, group_column=group_column)
    every = _time_counts(df, duration_column, event_column, group_column)
    found = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if found:  # no valid row at all gives empty curves
        require_count(found, 10, "survival analysis")
    times = every.filter("group is not null")
    sizes = times.groupBy("group").agg(F.sum("n").alias("size"))
    kept = sizes.filter(F.col("size") >= MIN_GROUP)
    # every curve starts at time zero
    start = kept.select("group", F.lit(0.0).alias("timeline"), F.lit(0).alias("n"), F.lit(0).alias("events"))
    points = (
        times.unionByName(start)
        .groupBy("group", "timeline")
        .agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
        .join(kept, "group")
    )
    cuts = find_cuts(times.select("timeline"), ["timeline"], rows_per_bucket)
    left = running_sums(points, ["group"], ["timeline"], {"gone": F.col("n")}, inclusive=False, cuts=cuts)
    left = left.withColumn("at_risk", F.col("size") - F.col("gone"))
    d, n = F.col("events"), F.col("at_risk")
    drop = F.when((d > 0) & (d < n), F.log(1 - d / n)).otherwise(F.lit(0.0))
    greenwood = F.when((d > 0) & (d < n), d / (n * (n - d))).otherwise(F.lit(0.0))
    summed = running_sums(
        left,
        ["group"],
        ["timeline"],
        {"_log": drop, "_var": greenwood, "_dead": ((d > 0) & (d >= n)).cast("int")},
        cuts=cuts,
    )
    s = F.when(F.col("_dead") > 0, F.lit(0.0)).otherwise(F.exp("_log"))
    z = normal_quantile((1 + confidence_level) / 2)
    inside = (F.col("survival_probability") > 0) & (F.col("survival_probability") < 1)
    log_s = F.when(inside, F.log("survival_probability"))
    band = lambda sign: F.exp(
        -F.exp(F.log(-log_s) + F.lit(sign * z) * F.sqrt("_var") / log_s)
    )
    edge = F.col("survival_probability")
    rows = summed.withColumn("survival_probability", s).select(
        F.col("group").cast("string").alias("group"),
        "timeline",
        "survival_probability",
        F.when(inside, band(1.0)).otherwise(edge).alias("survival_lower"),
        F.when(inside, band(-1.0)).otherwise(edge).alias("survival_upper"),
        "at_risk",
        "events",
    )
    median = rows.groupBy("group").agg(
        F.coalesce(F.min(F.when(F.col("survival_probability") <= 0.5, F.col("timeline"))), F.lit(float("inf"))).alias(
            "median_survival"
        )
    )
    skipped = sizes.filter(F.col("size") < MIN_GROUP).select(F.col("group").cast("string").alias("group"), "size")
    tables = {
        "median_survival": median,
        "groups_skipped": skipped,
    }
    if log_rank:
        tables["log_rank_test"] = _logrank(times, confidence_level, rows_per_bucket)
    metrics = sizes.agg(F.sum("size").alias("total_rows"), F.count("*").alias("groups"))
    return ProfileResult(rows, tables, metrics)


def logrank(
    df: DataFrame,
    duration_column: str,
    event_column: str,
    group_column: str,
    confidence_level: float = 0.95,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """k-sample log-rank test over all groups."""
    times = _time_counts(df, duration_column, event_column, group_column).filter("group is not null")
    return _logrank(times, confidence_level, rows_per_bucket)


def _logrank(per_group: DataFrame, confidence_level: float, rows_per_bucket: int | None) -> DataFrame:
    """The test from (group, timeline, n, events) counts.

    Expected events of a group are its members' cumulative hazards, read off one running
    sum over all times. The statistic is z'x with Vx = z, where z are events beyond the
    expected ones and V their covariance. V is never formed: it is a diagonal less the
    weighted products of the risk sets, so V times a vector is two running sums over the
    times (``_risk_products``), and x comes from conjugate gradients, whose vectors are
    tables with a row per group. Groups that no event finds at risk have neither variance
    nor surplus and take no part.
    """
    spark = per_group.sparkSession
    schema = "test_statistic double, degrees_of_freedom int, p_value double, significant boolean"
    overall = per_group.groupBy("timeline").agg(F.sum("n").alias("n"), F.sum("events").alias("d"))
    total = per_group.agg(F.sum("n").alias("n"), F.count_distinct("group").alias("k")).first()
    if total["k"] < 2:
        return spark.createDataFrame([], schema)
    cuts = find_cuts(overall.select("timeline"), ["timeline"], rows_per_bucket)
    r, d = F.lit(total["n"]) - F.col("gone"), F.col("d")
    factor = F.when((r > 1) & (d > 0), d * (r - d) / (r - 1)).otherwise(F.lit(0.0))
    risk = running_sums(overall, [], ["timeline"], {"gone": F.col("n")}, inclusive=False, cuts=cuts)
    steps = risk.select("timeline", (d / r).alias("hazard"), (factor / r).alias("spread"), (factor / (r * r)).alias("w"))
    hazards = cut_lineage(running_sums(steps, [], ["timeline"], {"h": F.col("hazard"), "a": F.col("spread")}, cuts=cuts))
    found = per_group.join(hazards.select("timeline", "h", "a"), "timeline").groupBy("group").agg(
        (F.sum("events") - F.sum(F.col("n") * F.col("h"))).alias("z"), F.sum(F.col("n") * F.col("a")).alias("v"), F.sum("n").alias("size")
    )
    groups = cut_lineage(found.filter("v > 0"))
    statistic = _solved_form(per_group, hazards.select("timeline", "w"), groups, cuts)
    p = chi2_tail(statistic, total["k"] - 1)
    return spark.createDataFrame([(statistic, total["k"] - 1, p, bool(p < 1 - confidence_level))], schema)


def _risk_products(per_group: DataFrame, weights: DataFrame, state: DataFrame, cuts: Cuts) -> DataFrame:
    """``state`` with ``q``, the covariance times the vector in its column ``p``.

    The first running sum gives, at every time, the risk sets' product with the vector: all
    groups' members less those who left before. The second adds these products up to the
    time at which a member leaves, and a group's value is the sum over its members.
    """
    whole = state.agg(F.sum(F.col("size") * F.col("p")).alias("s")).first()["s"]
    leaving = per_group.join(state.select("group", "p"), "group").groupBy("timeline").agg(F.sum(F.col("n") * F.col("p")).alias("m"))
    moved = weights.join(leaving, "timeline", "left").select("timeline", "w", F.coalesce("m", F.lit(0.0)).alias("m"))
    left = running_sums(moved, [], ["timeline"], {"gone": F.col("m")}, inclusive=False, cuts=cuts)
    product = left.select("timeline", (F.col("w") * (F.lit(whole) - F.col("gone"))).alias("ws"))
    summed = running_sums(product, [], ["timeline"], {"u": F.col("ws")}, cuts=cuts)
    common = per_group.join(summed.select("timeline", "u"), "timeline").groupBy("group").agg(F.sum(F.col("n") * F.col("u")).alias("c"))
    return state.join(common, "group").select(*state.columns, (F.col("v") * F.col("p") - F.col("c")).alias("q"))


def _solved_form(per_group: DataFrame, weights: DataFrame, groups: DataFrame, cuts: Cuts) -> float:
    """z'x for Vx = z by conjugate gradients, scaled by ``v``, the larger part of the diagonal.

    Each round writes its vectors once and brings three numbers to the driver.
    """
    size = groups.agg(F.sum(F.col("z") * F.col("z") / F.col("v")).alias("s")).first()["s"] or 0.0
    start, statistic = size, 0.0
    state = groups.select("group", "size", "v", "z", F.col("z").alias("r"), (F.col("z") / F.col("v")).alias("p"))
    for _ in range(MAX_ROUNDS):
        if size <= SOLVED * start:
            return statistic
        done = cut_lineage(_risk_products(per_group, weights, state, cuts))
        along = done.agg(F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("z") * F.col("p")).alias("zp")).first()
        step = size / along["pq"]
        statistic += step * along["zp"]
        rest = F.col("r") - F.lit(step) * F.col("q")
        before, size = size, done.agg(F.sum(rest * rest / F.col("v")).alias("s")).first()["s"]
        turned = rest / F.col("v") + F.lit(size / before) * F.col("p")
        state = done.select("group", "size", "v", "z", rest.alias("r"), turned.alias("p"))
    raise RuntimeError(f"the log-rank covariance was not solved in {MAX_ROUNDS} rounds")
