"""Cohort retention and stage funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import clean, moment
from statloom.functions.totals import attach_totals
from statloom.result import ProfileResult, as_list, quoted, require_columns

# The autumn term starts with this month.
FALL_MONTH = 8


def _period(date: Column, grain: str) -> tuple[Column, Column]:
    """Label of the period and a number that sorts periods by time."""
    year, fall = F.year(date), F.month(date) >= FALL_MONTH
    if grain == "semester":
        term = F.when(fall, "-Fall").otherwise("-Spring")
        return F.concat(year.cast("string"), term), year * 2 + fall.cast("int")
    return year.cast("string"), year * 2


def retention(
    df: DataFrame,
    student_id_column: str,
    cohort_column: str,
    event_date_column: str,
    period_grain: str = "semester",
    period_order: str = "label",
) -> ProfileResult:
    """Distinct members per cohort and period, relative to the cohort's first period.

    ``period_order="label"`` takes the smallest label as first period (a Fall label sorts
    before the Spring of the same year); ``"chronological"`` goes by time.
    """
    if period_grain not in ("semester", "annual"):
        raise ValueError("period_grain must be 'semester' or 'annual'")
    if period_order not in ("label", "chronological"):
        raise ValueError("period_order must be 'label' or 'chronological'")
    require_columns(
        df, student_id_column=student_id_column, cohort_column=cohort_column, event_date_column=event_date_column
    )
    date = moment(df, event_date_column)
    label, position = _period(date, period_grain)
    work = df.select(
        clean(df, student_id_column).alias("student_id"),
        clean(df, cohort_column).alias("cohort"),
        label.alias("period"),
        position.alias("_at"),
    ).dropna()
    enrolled = work.groupBy("cohort", "period", "_at").agg(F.count_distinct("student_id").alias("enrolled_count"))
    by = "period" if period_order == "label" else "_at"
    first = enrolled.groupBy("cohort").agg(F.min_by("enrolled_count", by).alias("_initial"))
    rate = F.least(F.greatest(F.col("enrolled_count") / F.col("_initial"), F.lit(0.0)), F.lit(1.0))
    rows = (
        enrolled.join(first, "cohort")
        .withColumn("retention_rate", rate)
        .withColumn("attrition_rate", 1 - F.col("retention_rate"))
        .orderBy("cohort", by)
        .select("cohort", "period", "enrolled_count", "retention_rate", "attrition_rate")
    )
    metrics = attach_totals(
        enrolled.agg(F.count_distinct("cohort").alias("cohort_count"), F.count_distinct("period").alias("period_count")),
        work.agg(F.count_distinct("student_id").alias("total_students")),
    )
    return ProfileResult(rows, {}, metrics)


def cohort_flow(
    df: DataFrame,
    id_column: str,
    stage_column: str,
    stage_order: list[str],
    cohort_column: str | None = None,
    group_by: list[str] | None = None,
) -> ProfileResult:
    """Furthest stage per individual and the funnel of the ordered stages.

    An individual in two cohorts has one furthest stage in each; rows are joined back on
    id and cohort, so they never multiply. ``group_by`` gives one funnel per group.
    """
    stages = [str(s) for s in as_list(stage_order)]
    if not stages:
        raise ValueError("stage_order must list the stages in sequence")
    groups = as_list(group_by)
    require_columns(df, id_column=id_column, stage_column=stage_column)
    require_columns(df, columns=[id_column, *as_list(cohort_column), *groups])
    known = F.col(quoted(stage_column)).cast("string")
    rank = F.array_position(F.lit(stages), known).cast("int") - 1
    rank = F.when(rank >= 0, rank)
    keys = list(dict.fromkeys([id_column, *as_list(cohort_column), *groups]))
    furthest = (
        df.select(*[F.col(quoted(k)) for k in keys], rank.alias("_rank"))
        .filter(F.col("_rank").isNotNull())
        .dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.max("_rank").alias("_rank"))
    )
    reached = furthest.withColumn("stage_reached", F.element_at(F.lit(stages), F.col("_rank") + 1)).drop("_rank")
    rows = df.join(reached, keys, "left").select(*[quoted(c) for c in df.columns], "stage_reached")
    counts = [F.count_if(F.col("_rank") >= i).alias(f"_s{i}") for i in range(len(stages))]
    flat = (furthest.groupBy(*groups) if groups else furthest.groupBy()).agg(F.count("*").alias("_all"), *counts)
    steps = F.array(
        *[
            F.struct(
                F.lit(s).alias("stage"),
                F.lit(i).alias("stage_order"),
                F.col(f"_s{i}").alias("n_reached"),
                F.lit(1.0).alias("conversion_from_previous")
                if i == 0
                else F.coalesce(F.round(F.try_divide(F.col(f"_s{i}"), F.col(f"_s{i - 1}")), 4), F.lit(0.0)).alias(
                    "conversion_from_previous"
                ),
                F.coalesce(F.round(F.try_divide(F.col(f"_s{i}"), F.col("_all")), 4), F.lit(0.0)).alias("pct_of_start"),
            )
            for i, s in enumerate(stages)
        ]
    )
    funnel = flat.select(*groups, F.inline(steps))
    return ProfileResult(rows, {"funnel": funnel}, furthest.agg(F.count("*").alias("n_individuals")))
