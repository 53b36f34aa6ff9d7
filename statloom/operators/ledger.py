"""Analytics over the job ledger: history, spend, budgets, concurrency, failures.

A ledger is a table of finished jobs. Default column names: ``user_id``, ``job_id``,
``profile_id``, ``started_at``, ``cost``, ``estimated_cost``, ``duration_seconds``.
"""

from __future__ import annotations

import base64
import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.ordered import running_sums
from statloom.result import ProfileResult, require_columns

HISTORY_LIMIT = 20
SNAPSHOT_LIMIT = 50
BUDGET_LIMIT = 50.0
ALERT_THRESHOLD = 0.80
# Running totals of costs are decimals: the same in whatever order parts are added, so a total
# that equals the alert mark to the cent reaches it.
MONEY = "decimal(38,12)"
# Price of a job: GB-seconds at 3 GB (fixed values).
MEMORY_GB = 3.0
PRICE_PER_GB_SECOND = 0.0000166667
# Cost estimates scale with the input size around this baseline, within these factors.
BASELINE_BYTES = 10 * 1024 * 1024
SCALE_RANGE = (0.1, 10.0)


def _page_size(value: int, most: int) -> int:
    """A page size from 1 to ``most``; any other is an error, not a shorter page."""
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"limit has to be a whole number from 1 to {most}, not {value!r}")
    return value


def billed_cost(df: DataFrame, cost: str = "cost", estimate: str = "estimated_cost") -> Column:
    """Actual cost if present, else the estimate; never negative."""
    parts = [F.col(c).cast("double") for c in (cost, estimate) if c in df.columns]
    return F.greatest(F.coalesce(*parts, F.lit(0.0)), F.lit(0.0))


def alert_mark(limit: float, threshold: float) -> Decimal:
    """The total at which a budget alerts."""
    return Decimal(str(limit)) * Decimal(str(threshold))


def month_of(started_at: str) -> Column:
    return F.date_format(F.col(started_at), "yyyy-MM")


def _read_cursor(cursor: str | None) -> tuple[str, str] | None:
    try:
        found = json.loads(base64.b64decode(cursor or "").decode())
        return str(found["at"]), str(found["id"])
    except (ValueError, KeyError, TypeError):
        return None  # a malformed cursor starts from the beginning


def job_history(
    ledger: DataFrame,
    user: str | int | None = None,
    limit: int = 10,
    cursor: str | None = None,
    user_column: str = "user_id",
    started_column: str = "started_at",
    id_column: str = "job_id",
) -> ProfileResult:
    """Newest jobs first, at most 20 per user, with a cursor to the next page.

    For one user it is a filter and a top-k; for all users a row number per user, which
    Spark limits inside each partition before the shuffle.
    """
    limit = _page_size(limit, HISTORY_LIMIT)
    require_columns(ledger, user_column=user_column, started_column=started_column, id_column=id_column)
    newest = [F.col(started_column).desc(), F.col(id_column).desc()]
    rank = F.row_number().over(Window.partitionBy(user_column).orderBy(*newest))
    if user is None:
        rows = ledger.withColumn("position", rank).filter(F.col("position") <= limit)
        return ProfileResult(rows)
    mine = ledger.filter(F.col(user_column) == user)
    after = _read_cursor(cursor)
    if after:
        at, job = F.lit(after[0]).cast(ledger.schema[started_column].dataType), F.lit(after[1]).cast(
            ledger.schema[id_column].dataType
        )
        mine = mine.filter(
            (F.col(started_column) < at) | ((F.col(started_column) == at) & (F.col(id_column) < job))
        )
    page = mine.orderBy(*newest).limit(limit + 1).withColumn("position", rank)  # ≤ 21 rows
    rows = page.filter(F.col("position") <= limit)
    token = F.base64(
        F.to_json(F.struct(F.col(started_column).cast("string").alias("at"), F.col(id_column).cast("string").alias("id")))
    )
    metrics = page.agg(
        F.count_if(F.col("position") <= limit).alias("count"),
        F.when(F.count("*") > limit, F.max(F.when(F.col("position") == limit, token))).alias("next_cursor"),
    )
    return ProfileResult(rows, {}, metrics)


def list_snapshots(
    ledger: DataFrame,
    user: str | int,
    limit: int = 20,
    user_column: str = "user_id",
    label_column: str = "label",
    completed_column: str = "completed_at",
) -> ProfileResult:
    """Labelled results of one user, newest first, 1 to 50 of them."""
    limit = _page_size(limit, SNAPSHOT_LIMIT)
    labelled = ledger.filter((F.col(user_column) == user) & (F.trim(F.col(label_column)) != ""))
    rows = labelled.orderBy(F.col(completed_column).desc(), F.col(label_column)).limit(limit)
    return ProfileResult(rows, {}, rows.agg(F.count("*").alias("count")))


def monthly_spend(
    ledger: DataFrame,
    user_column: str = "user_id",
    started_column: str = "started_at",
    cost: str = "cost",
    estimate: str = "estimated_cost",
) -> ProfileResult:
    """Summed cost per user and month."""
    rows = (
        ledger.filter(F.col(user_column).isNotNull())
        .groupBy(user_column, month_of(started_column).alias("month"))
        .agg(F.sum(billed_cost(ledger, cost, estimate)).alias("spend"), F.count("*").alias("jobs"))
    )
    return ProfileResult(rows)


def budget_gate(
    requests: DataFrame,
    spend: DataFrame,
    limit: float = BUDGET_LIMIT,
    keys: list[str] = ("user_id", "month"),
    estimate: str = "estimated_cost",
) -> ProfileResult:
    """Projected spend per request and whether it stays within the limit."""
    joined = requests.join(spend.select(*keys, F.col("spend").alias("prior_spend")), list(keys), "left")
    prior = F.coalesce(F.col("prior_spend"), F.lit(0.0))
    projected = prior + F.coalesce(F.col(estimate), F.lit(0.0))
    rows = joined.withColumns(
        {"prior_spend": prior, "projected_spend": projected, "budget_ok": projected <= F.lit(float(limit))}
    )
    return ProfileResult(rows)


def budget_alerts(
    ledger: DataFrame,
    limit: float = BUDGET_LIMIT,
    threshold: float = ALERT_THRESHOLD,
    user_column: str = "user_id",
    started_column: str = "started_at",
    id_column: str = "job_id",
    cost: str = "cost",
    estimate: str = "estimated_cost",
    rows_per_bucket: int | None = None,
) -> ProfileResult:
    """The job at which a user's monthly spend first crosses the alert threshold.

    Running totals per (user, month) go through time buckets, so a user with a third of
    all jobs is spread over many tasks.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    jobs = ledger.select(
        F.col(user_column),
        F.col(id_column),
        F.col(started_column),
        month_of(started_column).alias("month"),
        billed_cost(ledger, cost, estimate).alias("job_cost"),
    )
    money = F.col("job_cost").cast(MONEY)
    total = running_sums(
        jobs,
        [user_column, "month"],
        [started_column, id_column],
        {"spend_before": money},
        inclusive=False,
        rows_per_bucket=rows_per_bucket,
    ).withColumn("spend_after", F.col("spend_before") + money)
    mark = F.lit(str(alert_mark(limit, threshold))).cast(MONEY)
    rows = total.filter((F.col("spend_after") >= mark) & (F.col("spend_before") < mark)).withColumns(
        {c: F.col(c).cast("double") for c in ("spend_before", "spend_after")}
    )
    return ProfileResult(rows)


def department_spend(
    ledger: DataFrame,
    cap: float = BUDGET_LIMIT,
    department_column: str = "department",
    started_column: str = "started_at",
    cost: str = "cost",
) -> ProfileResult:
    """Spend per department and month against the cap; a blank department is "default"."""
    name = F.trim(F.col(department_column).cast("string"))
    department = F.when(name != "", name).otherwise(F.lit("default"))
    rows = (
        ledger.groupBy(department.alias("department"), month_of(started_column).alias("month"))
        .agg(F.sum(F.coalesce(F.col(cost), F.lit(0.0))).alias("spend"))
        .withColumn("over_cap", F.col("spend") > F.lit(float(cap)))
    )
    return ProfileResult(rows)


def concurrent_jobs(
    ledger: DataFrame,
    limit: int = 2,
    user_column: str = "user_id",
    started_column: str = "started_at",
    ended_column: str = "ended_at",
    rows_per_bucket: int | None = None,
) -> ProfileResult:
    """Running jobs per user over time: rows are the moments with at least ``limit``.

    Starts and stops are summed per (user, moment) before the running total. A job stops
    before another one that starts at the same moment. Jobs without an end run on.
    """
    moves = ledger.select(
        F.col(user_column).alias("user_id"),
        F.explode(
            F.array(
                F.struct(F.col(started_column).alias("at"), F.lit(1).alias("step")),
                F.struct(F.col(ended_column).alias("at"), F.lit(-1).alias("step")),
            )
        ).alias("move"),
    ).select("user_id", "move.at", "move.step").filter(F.col("at").isNotNull())
    steps = moves.groupBy("user_id", "at").agg(F.sum("step").alias("step"))
    levels = running_sums(steps, ["user_id"], ["at"], {"running": F.col("step")}, rows_per_bucket=rows_per_bucket)
    rows = levels.filter(F.col("running") >= limit).select("user_id", "at", "running")
    peak = levels.groupBy("user_id").agg(
        F.max("running").alias("peak_running"), F.count_if(F.col("running") >= limit).alias("moments_at_limit")
    )
    return ProfileResult(rows, {"peak": peak})


def estimate_cost(
    requests: DataFrame,
    profiles: DataFrame,
    size_column: str = "size_bytes",
    profile_column: str = "profile_id",
    chain_column: str | None = None,
) -> ProfileResult:
    """Cost and duration scaled by input size; a chained profile adds its own estimate.

    ``profiles`` has the profile id, ``typical_cost`` and ``typical_seconds``.
    """
    raw = F.col(size_column) / F.lit(float(BASELINE_BYTES))
    clamped = F.least(F.greatest(raw, F.lit(SCALE_RANGE[0])), F.lit(SCALE_RANGE[1]))
    scale = F.when(F.col(size_column) > 0, clamped).otherwise(F.lit(1.0))
    base = requests.join(
        profiles.select(
            F.col(profile_column), F.col("typical_cost").alias("_c"), F.col("typical_seconds").alias("_s")
        ),
        profile_column,
        "left",
    )
    cost, seconds = F.round(F.col("_c") * scale, 6), F.round(F.col("_s") * scale, 1)
    if chain_column:
        base = base.join(
            profiles.select(
                F.col(profile_column).alias(chain_column),
                F.col("typical_cost").alias("_c2"),
                F.col("typical_seconds").alias("_s2"),
            ),
            chain_column,
            "left",
        )
        cost = cost + F.coalesce(F.col("_c2"), F.lit(0.0))
        seconds = seconds + F.coalesce(F.col("_s2"), F.lit(0.0))
    rows = base.withColumns({"estimated_cost": cost, "estimated_seconds": seconds}).drop("_c", "_s", "_c2", "_s2")
    return ProfileResult(rows)


def job_metrics(
    ledger: DataFrame,
    user_column: str = "user_id",
    profile_column: str = "profile_id",
    cost: str = "cost",
    duration: str = "duration_seconds",
) -> ProfileResult:
    """Cost by (profile, user) and by user, duration by profile, in one grouped pass."""
    p, u = F.col(profile_column), F.col(user_column)
    sets = ledger.groupingSets([[p, u], [u], [p]], p, u).agg(
        F.grouping_id().alias("_g"),
        F.sum(billed_cost(ledger, cost)).alias("_cost"),
        F.sum(F.col(duration)).alias("_seconds"),
        F.count("*").alias("jobs"),
    )
    by_profile = F.col("_g") == 1
    rows = sets.select(
        F.when(by_profile, "JobDuration").otherwise("JobCost").alias("metric"),
        p.alias("profile_id"),
        u.alias("user_id"),
        F.when(by_profile, F.col("_seconds")).otherwise(F.col("_cost")).alias("value"),
        F.col("jobs"),
    )
    return ProfileResult(rows)


def compute_cost(elapsed_seconds: Column, memory_gb: float = MEMORY_GB) -> Column:
    return elapsed_seconds * F.lit(memory_gb) * F.lit(PRICE_PER_GB_SECOND)


def failure_summary(
    ledger: DataFrame,
    profile_column: str = "profile_id",
    code_column: str = "error_code",
    cause_column: str = "cause",
) -> ProfileResult:
    """Readable message per failed job, and counts by profile and error code.

    The message is ``errorMessage`` of a JSON cause, else the cause itself, else a
    default sentence.
    """
    code = F.coalesce(F.col(code_column), F.lit("UnknownError"))
    filled = lambda c: F.when(c != "", c)
    # the default sentence is a fixed value: it is part of the result
    message = F.coalesce(
        filled(F.get_json_object(F.col(cause_column), "$.errorMessage")),
        filled(F.col(cause_column)),
        F.concat(F.lit("Job failed with error: "), code),
    )
    rows = ledger.withColumns({"error_code": code, "error_message": message})
    summary = rows.groupBy(profile_column, "error_code").agg(
        F.count("*").alias("failures"), F.min("error_message").alias("example_message")
    )
    return ProfileResult(rows, {"summary": summary})
