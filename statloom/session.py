"""Session helpers: local test sessions and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "statloom", **conf) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only used where the setting is absent and the master is
    local, as in tests; on a cluster the setting has to be there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="statloom-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder once and go on from the written copy.

    Ends the lineage of a loop and survives lost executors. Unlike an eager checkpoint it
    runs the plan only once, and the copy has known sizes for the next joins.
    """
    spark = df.sparkSession
    path = work_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that a task is given where the number of tasks has to follow the input.
TASK_ROWS = 1_000_000


def tasks_for(rows: int) -> int:
    """Tasks for so many rows: their share, and so their memory, stays the same."""
    return int(rows // TASK_ROWS) + 1


def work_path(spark: SparkSession) -> str:
    """A new path in this application's folder under the shared folder."""
    return f"{_work_folder(spark)}/{uuid.uuid4().hex}"


_FOLDERS: dict[str, str] = {}


def _work_folder(spark: SparkSession) -> str:
    """One folder per application under the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark).rstrip('/')}/statloom-{app}"
    return _FOLDERS[app]
