"""Writing results, exports, manifests, audit records and catalogue entries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from statloom.result import ProfileResult, quoted, require_columns

def write_result(result: ProfileResult, path: str, sources: int = 1, join_type: str | None = None) -> dict:
    """Write rows as Parquet with a metadata record beside them.

    The row count is observed during the write, so the plan runs once.
    """
    started = time.time()
    seen = Observation()
    result.rows.observe(seen, F.count("*").alias("row_count")).write.mode("overwrite").parquet(f"{path}/data.parquet")
    metadata = {
        "row_count": int(seen.get["row_count"]),
        "column_count": len(result.rows.columns),
        "columns": result.rows.columns,
        "elapsed_seconds": round(time.time() - started, 3),
        "sources": sources,
        "join_type": join_type,
    }
    spark = result.rows.sparkSession
    schema = "row_count long, column_count int, columns array<string>, elapsed_seconds double, sources int, join_type string"
    spark.createDataFrame([tuple(metadata.values())], schema).write.mode("overwrite").json(f"{path}/metadata")
    return metadata


def export_csv(df: DataFrame, path: str, row_limit: int | None = None, order: list[str] | None = None) -> None:
    """All rows as CSV with a header, or the first ``row_limit`` of them by ``order``.

    Without an order the first rows are those by all columns, so a limit always means the
    same rows.
    """
    if row_limit is not None:
        df = df.orderBy(*(order or df.columns)).limit(row_limit)
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, path: str, uris: DataFrame | list[str], file_format: str = "PARQUET") -> None:
    """A manifest that points to result files, one JSON line per file.

    ``uris`` is a DataFrame whose first column names the files; executors write its lines,
    so a manifest may name any number of them. A short list will do too.
    """
    if not isinstance(uris, DataFrame):
        uris = spark.createDataFrame([(u,) for u in uris], "uri string")
    location = F.array(F.struct(F.array(F.col(quoted(uris.columns[0])).cast("string")).alias("URIs")))
    settings = F.struct(F.lit(file_format).alias("format"))
    uris.select(location.alias("fileLocations"), settings.alias("globalUploadSettings")).write.mode("overwrite").json(path)


AUDIT_COLUMNS = [
    "job_id",
    "profile_id",
    "user_id",
    "dataset_uri",
    "params",
    "result_uri",
    "cost",
    "duration_seconds",
    "status",
    "timestamp",
]


def audit_records(jobs: DataFrame) -> DataFrame:
    """One record per finished job, with the estimate where no actual cost is known."""
    require_columns(jobs, columns=["job_id", "profile_id", "user_id", "status", "timestamp"])
    filled = lambda c, kind="string": F.col(c) if c in jobs.columns else F.lit(None).cast(kind)
    params = filled("params")
    if "params" in jobs.columns and not jobs.schema["params"].dataType.simpleString().startswith("string"):
        params = F.to_json("params")
    return jobs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("job_id", "profile_id", "user_id")],
        filled("dataset_uri").alias("dataset_uri"),
        params.alias("params"),
        filled("result_uri").alias("result_uri"),
        F.coalesce(filled("cost", "double"), filled("estimated_cost", "double")).alias("cost"),
        filled("duration_seconds", "double").alias("duration_seconds"),
        F.coalesce(F.col("status"), F.lit("UNKNOWN")).alias("status"),
        F.col("timestamp"),
    )


def append_audit(jobs: DataFrame, path: str) -> None:
    """Append audit records, laid out by year and month."""
    dated = audit_records(jobs).withColumns({"year": F.year("timestamp"), "month": F.month("timestamp")})
    dated.write.mode("append").partitionBy("year", "month").parquet(path)


def register_results(jobs: DataFrame, prefix: str = "compute-result-") -> DataFrame:
    """Catalogue rows of job results."""
    require_columns(jobs, columns=["job_id", "profile_id", "user_id", "result_uri", "registered_at"])
    return jobs.select(
        F.concat(F.lit(prefix), F.col("job_id").cast("string")).alias("source_id"),
        F.lit("s3").alias("source_type"),
        F.col("result_uri").alias("uri"),
        F.concat(F.col("profile_id"), F.lit(" results — "), F.col("registered_at").cast("string")).alias("name"),
        F.col("user_id").cast("string").alias("created_by"),
        F.array("profile_id", F.lit("compute-result")).alias("tags"),
        F.lit("internal").alias("data_classification"),
        F.col("registered_at"),
    )


def latest_registered(catalogue: DataFrame) -> DataFrame:
    """The newest row per source; a grouped maximum, so a hot source stays one row per task."""
    rest = [c for c in catalogue.columns if c != "source_id"]
    newest = F.max_by(F.struct(*rest), F.struct("registered_at", "uri")).alias("_row")
    return catalogue.groupBy("source_id").agg(newest).select("source_id", *[f"_row.{c}" for c in rest])
