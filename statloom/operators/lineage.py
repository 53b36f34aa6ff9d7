"""Data lineage from the job history, and checks of reported results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.missing import moment, number
from statloom.functions.ordered import find_cuts, previous_row, running_sums
from statloom.result import ProfileResult, numeric_features, require_columns
from statloom.session import cut_lineage

HISTORY = ["job_id", "profile_id", "started_at", "source_uri", "result_uri"]


def lineage_gaps(jobs: DataFrame, keys: list[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Consecutive jobs (by start) where the previous result is not the next input.

    ``stage`` counts jobs from 0. With ``keys`` every key is a chain of its own.
    """
    keys, order = list(keys), ["_at", "job_id"]
    jobs = jobs.withColumn("_at", moment(jobs, "started_at"))
    cuts = find_cuts(jobs, order, rows_per_bucket)
    staged = running_sums(jobs, keys, order, {"stage": F.lit(1)}, inclusive=False, cuts=cuts)
    linked = previous_row(staged, keys, order, {"previous_result": "result_uri"}, cuts=cuts)
    broken = (
        (F.col("previous_result") != "") & (F.col("source_uri") != "") & (F.col("previous_result") != F.col("source_uri"))
    )
    text = F.concat(
        F.lit("Output '"), F.col("previous_result"), F.lit("' does not match input '"), F.col("source_uri"), F.lit("'")
    )
    return linked.filter(broken).select(*keys, "stage", "job_id", "previous_result", "source_uri", text.alias("description"))


def _touching(history: DataFrame, uris: DataFrame) -> DataFrame:
    hit = history.join(uris, F.col("source_uri") == F.col("uri"), "left_semi")
    return hit.unionByName(history.join(uris, F.col("result_uri") == F.col("uri"), "left_semi")).distinct()


def provenance(
    history: DataFrame,
    artifact_uri: str,
    lookback_days: int = 365,
    max_depth: int = 1,
    as_of: str | None = None,
    rows_per_bucket: int | None = None,
) -> ProfileResult:
    """Jobs that read or wrote an artifact, the files they touched, and breaks in the chain.

    ``max_depth`` above one follows the files of the found jobs further. ``as_of`` limits
    jobs to the lookback window before that moment. The PROV document comes as one JSON
    record per entity and activity, the Markdown summary as one line per step.
    """
    artifact = artifact_uri.strip()
    if not artifact:
        raise ValueError("the lineage of nothing: give the URI of an artifact")
    require_columns(history, columns=HISTORY)
    optional = [c for c in ("completed_at", "user_id") if c in history.columns]
    jobs = history.select(*HISTORY, *optional)
    if as_of:
        end = F.lit(as_of).cast("timestamp_ntz")
        start = moment(jobs, "started_at")
        jobs = jobs.filter((start <= end) & (start >= end - F.expr(f"interval {int(lookback_days)} days")))
    found = jobs.filter((F.col("source_uri") == artifact) | (F.col("result_uri") == artifact))
    for _ in range(max_depth - 1):
        uris = found.select(F.explode(F.array("source_uri", "result_uri")).alias("uri")).filter("uri <> ''").distinct()
        wider = cut_lineage(_touching(jobs, uris))
        if wider.count() == found.count():
            break
        found = wider
    timed = found.withColumn("_at", moment(found, "started_at"))
    cuts = find_cuts(timed, ["_at", "job_id"], rows_per_bucket)
    numbered = running_sums(timed, [], ["_at", "job_id"], {"step": F.lit(1)}, cuts=cuts).drop("_at")
    activities = numbered.withColumn("id", F.concat(F.lit("activity:"), F.col("job_id").cast("string")))
    roles = F.array(
        F.struct(F.col("source_uri").alias("uri"), F.lit("input").alias("role")),
        F.struct(F.col("result_uri").alias("uri"), F.lit("output").alias("role")),
    )
    # the first role a file is seen in, inputs before outputs of the same job
    entities = (
        numbered.select("step", F.posexplode(roles).alias("pos", "e"))
        .select("step", "pos", "e.uri", "e.role")
        .filter("uri <> ''")
        .groupBy("uri")
        .agg(F.min_by("role", F.struct("step", "pos")).alias("role"))
        .withColumn("id", F.concat(F.lit("entity:"), F.col("uri")))
    )
    started = F.col("started_at").cast("string")
    activity_json = F.to_json(
        F.struct(
            "id",
            F.lit("prov:Activity").alias("type"),
            "profile_id",
            started.alias("startedAtTime"),
            *[
                F.col(c).cast("string").alias(n)
                for c, n in (("completed_at", "endedAtTime"), ("user_id", "wasAssociatedWith"))
                if c in optional
            ],
        )
    )
    entity_json = F.to_json(F.struct("id", F.lit("prov:Entity").alias("type"), "uri", "role"))
    document = activities.select(F.lit("activity").alias("kind"), "id", activity_json.alias("json")).unionByName(
        entities.select(F.lit("entity").alias("kind"), "id", entity_json.alias("json"))
    )
    line = F.concat(
        F.lit("**Step "), F.col("step").cast("string"), F.lit("**: `"), F.col("profile_id"), F.lit("` — "), F.substring(started, 1, 10)
    )
    tables = {
        "entities": entities,
        "gaps": lineage_gaps(found, rows_per_bucket=rows_per_bucket),
        "prov_document": document,
        "markdown": activities.select("step", line.alias("line")).orderBy("step"),
    }
    return ProfileResult(activities, tables, activities.agg(F.count("*").alias("activities_found")))


def reproducibility_check(reported: DataFrame, computed: DataFrame, tolerance: float = 1e-4) -> ProfileResult:
    """Compare reported values with the means of the same-named columns.

    ``reported`` has columns metric and value (text or number). Numbers match within the
    tolerance, other values as text; missing values and unknown metrics are reported.
    """
    require_columns(reported, columns=["metric", "value"])
    numeric = numeric_features(computed)
    texts = [c for c in computed.columns if c not in numeric]
    means = computed.agg(*[F.avg(number(computed, c)).alias(c) for c in numeric]) if numeric else None
    values = computed.sparkSession.createDataFrame([], "metric string, computed double")
    if means is not None:
        values = means.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("computed")) for c in numeric]))
        )
    # a text column counts as a value when it holds the same text throughout
    constants = computed.sparkSession.createDataFrame([], "metric string, computed_text string")
    if texts:
        row = computed.agg(
            *[F.when(F.min(F.col(f"`{c}`").cast("string")) == F.max(F.col(f"`{c}`").cast("string")), F.min(F.col(f"`{c}`").cast("string"))).alias(c) for c in texts]
        )
        constants = row.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("computed_text")) for c in texts]))
        )
    text = F.col("value").cast("string")
    joined = reported.join(values, "metric", "left").join(constants, "metric", "left")
    as_number = text.try_cast("double")
    delta = F.abs(as_number - F.col("computed"))
    same_text = text == F.coalesce(F.col("computed_text"), F.col("computed").cast("string"))
    known = F.col("computed").isNotNull() | F.col("computed_text").isNotNull()
    numbers = as_number.isNotNull() & F.col("computed").isNotNull()
    status = (
        F.when(text.isNull() | ~known, "discrepancy")
        .when(numbers, F.when(delta <= tolerance, "match").otherwise("discrepancy"))
        .otherwise(F.when(same_text, "match").otherwise("discrepancy"))
    )
    # fixed values: these sentences are part of the result
    error = F.when(text.isNull(), F.lit("No 'value' field in manuscript entry")).when(
        ~known, F.concat(F.lit("Metric '"), F.col("metric"), F.lit("' not found in computed output"))
    )
    rows = joined.select(
        "metric",
        text.alias("reported"),
        "computed",
        F.when(numbers, F.round(delta, 10)).alias("delta"),
        status.alias("status"),
        error.alias("error"),
    )
    metrics = rows.agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("status") == "match").alias("matches"),
        F.count_if(F.col("status") == "discrepancy").alias("discrepancies"),
    )
    return ProfileResult(rows, {}, metrics)
