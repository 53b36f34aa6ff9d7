"""Outcome gaps between groups, rates, benchmarking against peers, aid packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.missing import clean, number
from statloom.functions.ordered import average_ranks
from statloom.functions.totals import attach_totals
from statloom.operators.regression import logistic_irls
from statloom.result import ProfileResult, as_list, quoted, require_columns

# A disparate impact ratio below this is adverse (the four-fifths rule).
ADVERSE_BELOW = 0.80
# Upper bounds of the net price bands and their names (fixed values).
AID_BANDS = [(5000, "<$5k"), (10000, "$5-10k"), (15000, "$10-15k"), (None, ">$15k")]
PEER_WEIGHTS = {"enrollment": 0.4, "mission": 0.4, "pell": 0.2}


def _group_summary(df: DataFrame, metric: str, groups: list[str]) -> DataFrame:
    """Count, sum, mean and deviation per group, rows with a missing key included."""
    work = df.select(*[clean(df, g).alias(g) for g in groups], number(df, metric).alias("_x")).filter("_x is not null")
    return work.groupBy(*groups).agg(
        F.count("*").alias("n"), F.sum("_x").alias("_sum"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std")
    )


def _matches(groups: list[str], reference) -> Column:
    cond = F.lit(True)
    for g, v in zip(groups, as_list(reference)):
        cond = cond & (F.col(quoted(g)).cast("string") == F.lit(str(v)))
    return cond


def equity_gap(
    df: DataFrame,
    metric_column: str,
    group_columns: list[str],
    reference_group: str | None = None,
    min_group_size: int = 10,
) -> ProfileResult:
    """Group means of a metric against a reference group, or against the overall mean.

    The reference applies with a single group column and is matched as text. Groups below
    the minimum size stay out of the table and leave NULLs on their rows.
    """
    groups = as_list(group_columns)
    require_columns(df, metric_column=metric_column, group_columns=groups)
    everyone = _group_summary(df, metric_column, groups)
    named = F.lit(True)
    for g in groups:
        named = named & F.col(quoted(g)).isNotNull()
    large = named & (F.col("n") >= min_group_size)
    use_reference = reference_group is not None and len(groups) == 1
    wanted = _matches(groups, str(reference_group)) if use_reference else F.lit(False)
    overall = F.sum("_sum") / F.sum("n")
    totals = everyone.agg(
        overall.alias("overall_mean"),
        F.coalesce(F.max(F.when(large & wanted, F.col("mean"))), overall).alias("reference_mean"),
    )
    table = (
        attach_totals(everyone.filter(large), totals)
        .withColumn("gap_from_reference", F.col("mean") - F.col("reference_mean"))
        .withColumn("equity_index", F.try_divide(F.col("mean"), F.col("reference_mean")))
    )
    rows = df.join(
        table.select(*groups, F.col("mean").alias("group_mean"), "equity_index"), groups, "left"
    ).select(*[quoted(c) for c in df.columns], "group_mean", "equity_index")
    published = table.select(
        *groups, "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "gap_from_reference", "equity_index", "reference_mean")]
    )
    metrics = attach_totals(
        everyone.agg(
            F.count_if(large).alias("n_groups_analyzed"),
            F.count_if(named & (F.col("n") < min_group_size)).alias("n_groups_excluded_small"),
        ),
        totals.select(F.round("overall_mean", 4).alias("overall_mean"), F.round("reference_mean", 4).alias("reference_mean")),
    )
    return ProfileResult(rows, {"gap_table": published}, metrics)


def dfwi(
    df: DataFrame,
    grade_column: str,
    dfwi_values: list[str] = ("D", "F", "W", "I"),
    group_by: list[str] | None = None,
    min_enrollment: int = 5,
    all_subsets: bool = False,
) -> ProfileResult:
    """Share of unsuccessful grades, overall or per group.

    Grades are matched as text; a missing grade counts as enrolled but not unsuccessful.
    ``all_subsets`` also gives the rate for every subset of the grouping columns.
    """
    groups = as_list(group_by)
    require_columns(df, grade_column=grade_column, **({"group_by": groups} if groups else {}))
    values = [str(v) for v in as_list(dfwi_values)]
    flagged = df.withColumn(
        "is_dfwi", F.coalesce(F.col(quoted(grade_column)).cast("string").isin(values), F.lit(False))
    )
    counts = [F.count("*").alias("n"), F.count_if("is_dfwi").alias("n_dfwi")]
    rate = F.round(F.try_divide(F.col("n_dfwi"), F.col("n")), 4).alias("dfwi_rate")
    if not groups:
        summary = flagged.agg(*counts).select(F.lit("overall").alias("group"), "n", "n_dfwi", rate)
    else:
        for g in groups:
            flagged = flagged.withColumn(g, clean(flagged, g))
        known = flagged.dropna(subset=groups)
        grouped = known.cube(*groups) if all_subsets else known.groupBy(*groups)
        summary = grouped.agg(*counts).filter(F.col("n") >= min_enrollment).select(*groups, "n", "n_dfwi", rate)
    metrics = flagged.agg(*counts).select(F.col("n").alias("overall_n"), rate.alias("overall_dfwi_rate"))
    return ProfileResult(flagged, {"dfwi_summary": summary}, metrics)


def peer_benchmark(
    df: DataFrame, metric_columns: list[str], id_column: str | None = None, focal_id: str | None = None
) -> ProfileResult:
    """z-scores (population deviation) and percentile ranks per metric, focal unit flagged.

    Percentiles come from counted values, so no task sorts the whole table.
    """
    metrics = as_list(metric_columns)
    require_columns(df, metric_columns=metrics, **({"id_column": id_column} if id_column else {}))
    stats = df.agg(
        *[F.count(number(df, m)).alias(f"n{i}") for i, m in enumerate(metrics)],
        *[F.avg(number(df, m)).alias(f"m{i}") for i, m in enumerate(metrics)],
        *[F.stddev_pop(number(df, m)).alias(f"s{i}") for i, m in enumerate(metrics)],
        F.count("*").alias("n_peers"),
    ).first()
    rows = df
    for i, m in enumerate(metrics):
        z, pct = f"{m}_zscore", f"{m}_percentile"
        if stats[f"n{i}"] < 2:
            rows = rows.withColumns({z: F.lit(None).cast("double"), pct: F.lit(None).cast("double")})
            continue
        x = number(df, m)
        ranks = average_ranks(df.select(x.alias("_x")), "_x", rank="_rank").select("_x", "_rank")
        rows = rows.withColumn("_x", x).join(ranks, "_x", "left")
        rows = rows.withColumns(
            {
                z: F.round(F.try_divide(F.col("_x") - F.lit(stats[f"m{i}"]), F.lit(stats[f"s{i}"])), 4),
                pct: F.round(F.col("_rank") / F.lit(float(stats[f"n{i}"])), 4) * 100,
            }
        ).drop("_x", "_rank")
    tables = {}
    spark = df.sparkSession
    if id_column and focal_id is not None:
        rows = rows.withColumn(
            "is_focal", F.coalesce(F.col(quoted(id_column)).cast("string") == F.lit(str(focal_id)), F.lit(False))
        )
        focal = F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        number(df, m).alias("value"),
                        F.col(quoted(f"{m}_zscore")).alias("zscore"),
                        F.col(quoted(f"{m}_percentile")).alias("percentile"),
                    )
                    for m in metrics
                ]
            )
        )
        tables["focal_institution_summary"] = rows.filter("is_focal").select(focal)
    # fixed value: part of the result
    note = f"Focal institution '{focal_id}' not found in dataset"
    found = F.lit(None).cast("string")
    summary = spark.range(1).select(F.lit(stats["n_peers"]).alias("n_peers"), found.alias("note"))
    if tables:
        summary = rows.agg(
            F.count("*").alias("n_peers"), F.when(F.count_if("is_focal") == 0, F.lit(note)).alias("note")
        )
    return ProfileResult(rows, tables, summary)


def find_peers(df: DataFrame, unit_id, weights: dict[str, float] | None = None) -> ProfileResult:
    """Units like the anchor unit, with a proximity score.

    Same class and control type, enrollment within 20 %, aid share within 10 points; a
    criterion is skipped where the column or the anchor's value is missing.
    """
    w = {**PEER_WEIGHTS, **(weights or {})}
    if "unit_id" not in df.columns:
        raise ValueError("column 'unit_id' not found")
    anchor = df.filter(F.col("unit_id") == F.lit(unit_id)).first()
    spark = df.sparkSession
    schema = "criterion string, lower string, upper string"
    if anchor is None:
        empty = df.limit(0).withColumn("score", F.lit(None).cast("double"))
        return ProfileResult(empty, {"criteria_used": spark.createDataFrame([], schema)})
    known = {c: anchor[c] for c in df.columns if anchor[c] is not None and anchor[c] == anchor[c]}
    rows = df.filter(F.col("unit_id") != F.lit(unit_id))
    score = F.lit(float(w["mission"]))
    criteria = []
    for c in ("carnegie_class", "control_type"):
        if c in known:
            rows = rows.filter(F.col(c) == F.lit(known[c]))
            criteria.append((c, str(known[c]), str(known[c])))
    near = lambda share: F.lit(1.0) - F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    if "total_enrollment" in known:
        e = float(known["total_enrollment"])
        rows = rows.filter(F.col("total_enrollment").between(e * 0.80, e * 1.20))
        score = score + F.lit(float(w["enrollment"])) * near(F.abs(F.col("total_enrollment") - e) / max(e, 1.0))
        criteria.append(("enrollment_band", str(e * 0.80), str(e * 1.20)))
    if "pell_pct" in known:
        p = float(known["pell_pct"])
        rows = rows.filter(F.col("pell_pct").between(p - 10.0, p + 10.0))
        score = score + F.lit(float(w["pell"])) * near(F.abs(F.col("pell_pct") - p) / 100.0)
        criteria.append(("pell_band", str(p - 10.0), str(p + 10.0)))
    rows = rows.withColumn("score", score).orderBy(F.col("score").desc(), "unit_id")
    return ProfileResult(rows, {"criteria_used": spark.createDataFrame(criteria, schema)})


def intersectionality(
    df: DataFrame,
    metric_column: str,
    group_columns: list[str],
    reference_group: list[str] | None = None,
    n_suppress: int = 10,
) -> ProfileResult:
    """Disparate impact ratio per cell of several group columns, small cells suppressed."""
    groups = as_list(group_columns)
    if len(groups) < 2:
        raise ValueError("intersections need two or more group columns")
    require_columns(df, metric_column=metric_column, group_columns=groups)
    if not isinstance(df.schema[metric_column].dataType, T.NumericType):
        raise ValueError(f"metric_column '{metric_column}' must be numeric")
    everyone = _group_summary(df, metric_column, groups)
    given = as_list(reference_group)
    wanted = _matches(groups, given) if len(given) == len(groups) else F.lit(False)
    overall = F.coalesce(F.sum("_sum") / F.sum("n"), F.lit(0.0))
    totals = everyone.agg(F.coalesce(F.max(F.when(wanted, F.col("mean"))), overall).alias("reference_mean"))
    cells = attach_totals(everyone.dropna(subset=groups), totals)
    shown = F.col("n") >= n_suppress
    ratio = F.round(F.try_divide(F.col("mean"), F.col("reference_mean")), 4)
    rows = cells.select(
        F.concat_ws("|", *[F.col(quoted(g)).cast("string") for g in groups]).alias("group_key"),
        F.when(shown, F.col("n")).alias("n"),
        F.when(shown, F.col("n").cast("string")).otherwise(F.lit(f"<{n_suppress}")).alias("n_display"),
        F.when(shown, F.round("mean", 4)).alias("group_mean"),
        F.when(shown, ratio).alias("di_ratio"),
        F.when(shown, ratio < ADVERSE_BELOW).alias("adverse_impact_flag"),
    )
    metrics = cells.agg(
        F.count_if(~shown).alias("suppressed_cells"), F.round(F.max("reference_mean"), 4).alias("reference_group_mean")
    )
    return ProfileResult(rows, {}, metrics)


def financial_aid(
    df: DataFrame,
    student_id_col: str = "student_id",
    aid_year_col: str = "aid_year",
    efc_col: str = "efc",
    total_grants_col: str = "total_grants",
    total_loans_col: str = "total_loans",
    persistence_col: str = "persistence_flag",
    gpa_col: str | None = None,
) -> ProfileResult:
    """Aid bands, persistence by band, a persistence model and the trend of unmet need."""
    needed = [student_id_col, aid_year_col, efc_col, total_grants_col, total_loans_col, persistence_col]
    require_columns(df, columns=needed)
    efc, grants, loans = number(df, efc_col), number(df, total_grants_col), number(df, total_loans_col)
    persisted = number(df, persistence_col)
    band = None
    for bound, name in AID_BANDS:
        if bound is None:
            band = band.otherwise(name)
        else:
            band = (F if band is None else band).when(F.col("net_price") < bound, name)
    work = df.withColumn("net_price", efc - grants).withColumns({"aid_band": band, "unmet_need": efc - grants - loans})
    aggs = [
        F.count("*").alias("count"),
        F.round(F.avg(persisted), 4).alias("persistence_rate"),
        F.round(F.avg("net_price"), 2).alias("mean_net_price"),
    ]
    if gpa_col and gpa_col in df.columns:
        aggs.append(F.round(F.avg(number(df, gpa_col)), 4).alias("mean_gpa"))
    cohort = work.groupBy("aid_band").agg(*aggs)
    model = logistic_irls(work, persistence_col, ["net_price", total_grants_col, total_loans_col])
    rows = model.rows.withColumn("predicted_persistence_prob", F.round("probability", 4)).drop("probability")
    trend = (
        work.filter(clean(df, aid_year_col).isNotNull())
        .groupBy(F.col(quoted(aid_year_col)).cast("string").alias("aid_year"))
        .agg(F.round(F.avg("unmet_need"), 2).alias("mean_unmet_need"), F.count("*").alias("student_count"))
        .orderBy("aid_year")
    )
    metrics = work.agg(
        F.count("*").alias("total_students"), F.round(F.avg(persisted), 4).alias("persistence_rate_overall")
    )
    tables = {
        "cohort_table": cohort,
        "regression_summary": model.tables["coefficients"].withColumn("coefficient", F.round("coefficient", 6)),
        "unmet_need_trend": trend,
    }
    return ProfileResult(rows, tables, metrics)
