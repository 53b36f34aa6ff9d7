"""Grant portfolios: burn rates, no-cost-extension risk, investigator health."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import clean, moment, number
from statloom.functions.totals import attach_totals
from statloom.operators.cluster import kmeans
from statloom.result import ProfileResult, quoted, require_columns
from statloom.session import cut_lineage

ENDING_SOON_DAYS = 60
CHECKPOINTS = 12
CHECKPOINT_DAYS = 30
# Weights of activity, continuity and sponsor diversity in the health score, and the
# counts at which activity and diversity are full (fixed values).
HEALTH_WEIGHTS = (0.4, 0.4, 0.2)
FULL_ACTIVITY, FULL_DIVERSITY = 3.0, 5.0


def grant_portfolio(
    df: DataFrame,
    amount_column: str,
    budget_column: str,
    date_column: str,
    award_id_column: str,
    pi_column: str | None = None,
    research_area_column: str | None = None,
    nce_threshold: float = 0.9,
    n_clusters: int = 3,
) -> ProfileResult:
    """Burn rate, share expended and extension risk per award, on every transaction.

    A budget repeated on all rows of an award counts once, differing budgets are slices
    and add up. Everything below the rows derives from one row per award.
    """
    optional = {"pi_column": pi_column, "research_area_column": research_area_column}
    require_columns(
        df,
        amount_column=amount_column,
        budget_column=budget_column,
        date_column=date_column,
        award_id_column=award_id_column,
        **{k: v for k, v in optional.items() if v},
    )
    usable = df.withColumns(
        {"_amount": number(df, amount_column), "_budget": number(df, budget_column), "_award": clean(df, award_id_column)}
    )
    known = usable.filter("_amount is not null and _award is not null")
    aggs = [
        F.sum("_amount").alias("total_spent"),
        F.when(F.min("_budget") == F.max("_budget"), F.min("_budget"))
        .otherwise(F.coalesce(F.sum("_budget"), F.lit(0.0)))
        .alias("total_budget"),
    ]
    if research_area_column:
        area = clean(df, research_area_column)
        first = F.struct(moment(df, date_column), area)
        aggs.append(F.min_by(area, F.when(area.isNotNull(), first)).alias("_area"))
    awards = known.groupBy("_award").agg(*aggs)
    awards = awards.withColumn("burn_rate", F.try_divide(F.col("total_spent"), F.col("total_budget"))).withColumns(
        {
            "pct_expended": F.col("burn_rate") * 100,
            "nce_risk": F.coalesce(F.col("burn_rate") > nce_threshold, F.lit(False)),
        }
    )
    per_award = ["burn_rate", "pct_expended", "nce_risk"]
    rows = usable.join(awards.select("_award", *per_award), "_award", "left").select(
        *[quoted(c) for c in df.columns], *per_award
    )
    summary = awards.select(
        F.col("_award").alias("award_id"),
        *[F.round(c, 4).alias(c) for c in ("total_spent", "total_budget", "burn_rate", "pct_expended")],
        "nce_risk",
    )
    tables = {"portfolio_summary": summary}
    if pi_column:
        # one record per (investigator, award) carries its row count into the shares
        parts = known.groupBy(clean(df, pi_column).alias("pi"), "_award").agg(
            F.sum("_amount").alias("_spent"), F.count("*").alias("_rows")
        )
        tables["pi_summary"] = (
            parts.filter("pi is not null")
            .join(awards.select("_award", "nce_risk"), "_award")
            .groupBy("pi")
            .agg(
                F.count("*").alias("n_awards"),
                F.sum("_spent").alias("total_spent"),
                F.round(F.sum(F.when(F.col("nce_risk"), F.col("_rows")).otherwise(0)) / F.sum("_rows"), 4).alias(
                    "pct_at_nce_risk"
                ),
            )
        )
    if research_area_column:
        filled = cut_lineage(awards.na.fill(0.0, ["burn_rate", "pct_expended"]))
        clustered = kmeans(filled, ["burn_rate", "pct_expended"], k=n_clusters, standardize=False).rows
        tables["area_clusters"] = clustered.select(
            F.col("_award").alias("award_id"), F.col("_area").alias("research_area"), F.col("cluster_id").alias("award_cluster")
        )
    metrics = attach_totals(
        awards.agg(
            F.count("*").alias("n_awards"),
            F.count_if("nce_risk").alias("n_at_nce_risk"),
            F.round(F.sum("total_spent"), 2).alias("total_portfolio_spend"),
            F.round(F.sum("total_budget"), 2).alias("total_portfolio_budget"),
        ),
        usable.agg(F.count_if(F.col("_amount").isNull() | F.col("_award").isNull()).alias("rows_excluded_missing_data")),
    )
    return ProfileResult(rows, tables, metrics)


def pi_health(
    df: DataFrame,
    pi_column: str,
    start_date_column: str,
    end_date_column: str,
    amount_column: str | None = None,
    sponsor_column: str | None = None,
    submission_date_column: str | None = None,
    as_of: datetime.date | str | None = None,
) -> ProfileResult:
    """Health score per investigator, portfolio summary and lead times per sponsor.

    Coverage of the twelve 30-day checkpoints is twelve maxima in the same grouped
    aggregate as the counts, so no grant row is multiplied.
    """
    require_columns(df, pi_column=pi_column, start_date_column=start_date_column, end_date_column=end_date_column)
    today = F.lit(str(as_of)).cast("date") if as_of else F.current_date()
    work = df.select(
        clean(df, pi_column).alias("pi"),
        moment(df, start_date_column).cast("date").alias("s"),
        moment(df, end_date_column).cast("date").alias("e"),
        (F.coalesce(number(df, amount_column), F.lit(0.0)) if amount_column else F.lit(0.0)).alias("amount"),
        (clean(df, sponsor_column) if sponsor_column else F.lit(None).cast("string")).alias("sponsor"),
        (moment(df, submission_date_column).cast("date") if submission_date_column else F.lit(None).cast("date")).alias("sub"),
    )
    s, e = F.col("s"), F.col("e")
    active = F.coalesce((s <= today) & (e >= today), F.lit(False))
    ending = F.coalesce((e >= today) & (e <= F.date_add(today, ENDING_SOON_DAYS)), F.lit(False))
    covered = [
        F.max(F.coalesce((e >= today) & (s <= c) & (c <= e), F.lit(False)).cast("int")).alias(f"_m{i}")
        for i, c in enumerate(F.date_add(today, CHECKPOINT_DAYS * m) for m in range(CHECKPOINTS))
    ]
    sponsors = F.count_distinct("sponsor") if sponsor_column else F.lit(1)
    per_pi = (
        work.filter("pi is not null")
        .groupBy(F.col("pi").cast("string").alias("pi"))
        .agg(F.count_if(active).alias("active_grants"), F.count_if(ending).alias("ending_soon"), sponsors.alias("_sponsors"), *covered)
    )
    months = sum((F.col(f"_m{i}") for i in range(1, CHECKPOINTS)), F.col("_m0"))
    health = (
        F.least(F.col("active_grants") / FULL_ACTIVITY, F.lit(1.0)) * HEALTH_WEIGHTS[0]
        + months / float(CHECKPOINTS) * HEALTH_WEIGHTS[1]
        + F.least(F.col("_sponsors") / FULL_DIVERSITY, F.lit(1.0)) * HEALTH_WEIGHTS[2]
    )
    rows = per_pi.select(
        "pi",
        "active_grants",
        "ending_soon",
        (F.lit(CHECKPOINTS) - months).alias("funding_gap_months"),
        F.round(F.col("ending_soon") / F.greatest(F.col("active_grants"), F.lit(1)), 3).alias("nce_risk_score"),
        F.round(health, 3).alias("health_score"),
    )
    portfolio = work.agg(
        F.count_if(active).alias("total_active_grants"),
        F.coalesce(F.sum(F.when(e >= today, F.col("amount"))), F.lit(0.0)).alias("total_active_amount"),
        F.count_distinct("pi").alias("pi_count"),
    )
    timing = (
        work.filter("sub is not null and sponsor is not null")
        .groupBy(F.col("sponsor").cast("string").alias("sponsor"))
        .agg(F.round(F.avg(F.datediff("s", "sub")), 1).alias("avg_lead_days"))
    )
    return ProfileResult(rows, {"portfolio_summary": portfolio, "sponsor_timing": timing}, portfolio)
