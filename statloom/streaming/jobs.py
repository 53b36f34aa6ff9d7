"""Streaming forms of the ledger analytics.

Sources are folders of Parquet files; every run takes the files it has not seen yet and
stops (``availableNow``), or keeps running with a trigger of the caller's choice.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructType

from statloom.operators.ledger import ALERT_THRESHOLD, BUDGET_LIMIT, MONEY, alert_mark, billed_cost, month_of

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def job_stream(spark: SparkSession, source_dir: str, schema: StructType, files: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(source_dir)


def run_incremental(
    op: Callable[[DataFrame], DataFrame], stream: DataFrame, sink: str, checkpoint: str, enabled: bool = True
) -> StreamingQuery | None:
    """Apply a batch operator to the files that came since the last run.

    Each batch is written to its own subfolder, so a repeated batch replaces itself. A
    disabled schedule does nothing.
    """
    if not enabled:
        return None

    def each(batch: DataFrame, batch_id: int) -> None:
        op(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def merged(spark: SparkSession, sink: str, keys: list[str], sums: list[str]) -> DataFrame:
    """What the batches of ``run_incremental`` wrote, one row per key: batches add up."""
    return spark.read.parquet(sink).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def stream_budget_alerts(
    jobs: DataFrame,
    limit: float = BUDGET_LIMIT,
    threshold: float = ALERT_THRESHOLD,
    user_column: str = "user_id",
    started_column: str = "started_at",
    id_column: str = "job_id",
) -> DataFrame:
    """One alert per user and month, at the job that crosses the threshold.

    The stream's own state keeps total and alert of every (user, month). Jobs of a batch
    count in the order of their start (null first), ids deciding ties; batches count as they
    come. The state lives in RocksDB: the session is set to that store where it names none.
    """
    session = jobs.sparkSession
    if session.conf.get(STATE_STORE, "").rsplit(".", 1)[-1] != "RocksDBStateStoreProvider":
        session.conf.set(STATE_STORE, ROCKSDB)
    kinds = {c: jobs.schema[c].dataType for c in (user_column, id_column)}
    blank = F.lit("") if isinstance(kinds[id_column], StringType) else F.lit(0)
    # plain names and values without nulls: the rows reach the processor as pandas tuples
    records = jobs.select(
        F.col(user_column).cast("string").alias("owner"),
        month_of(started_column).alias("month"),
        F.coalesce(F.col(started_column).cast("string"), F.lit("")).alias("at"),
        F.col(id_column).isNotNull().alias("named"),
        F.coalesce(F.col(id_column), blank.cast(kinds[id_column])).alias("job"),
        billed_cost(jobs).cast(MONEY).alias("cost"),
    )
    out = f"owner string, month string, named boolean, job {kinds[id_column].simpleString()}, spend_before double, spend_after double"
    processor = BudgetCrossing(alert_mark(limit, threshold))
    alerts = records.groupBy("owner", "month").transformWithStateInPandas(processor, out, "append", "None")
    job = F.when(F.col("named"), F.col("job")).alias(id_column)
    return alerts.select(F.col("owner").cast(kinds[user_column]).alias(user_column), "month", job, "spend_before", "spend_after")


class BudgetCrossing(StatefulProcessor):
    """Finds the job with which the total of a key reaches a mark.

    Chunks of a batch are taken one after the other. Until the alert, only the earliest
    jobs that together reach the mark are held, which are at most the mark divided by the
    smallest cost; afterwards, and for jobs without cost, only the total is kept.
    """

    def __init__(self, mark: Decimal):
        self._mark = mark

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._totals = handle.getValueState("totals", f"spend {MONEY}, alerted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        spend, alerted = self._totals.get() if self._totals.exists() else (Decimal(0), False)
        first = Earliest(self._mark - spend)
        # a total that starts at the mark, as for a mark of 0, has not crossed it by any job
        open_to_alert = not alerted and spend < self._mark
        added = Decimal(0)
        for chunk in rows:
            added += sum(chunk["cost"])
            if open_to_alert:
                costly = chunk[chunk["cost"] > 0]
                for at, named, job, cost in zip(costly["at"], costly["named"], costly["job"], costly["cost"]):
                    first.add((at, bool(named), job), cost)
        crossed = open_to_alert and first.reached()
        self._totals.update((spend + added, alerted or crossed))
        if crossed:
            (_, named, job), before, cost = first.crossing()
            yield pd.DataFrame([(*key, named, job, float(spend + before), float(spend + before + cost))], columns=["owner", "month", "named", "job", "spend_before", "spend_after"])

    def close(self) -> None:
        pass


class Earliest:
    """The earliest jobs whose costs reach a sum, whatever the order in which they come."""

    def __init__(self, wanted: float | Decimal):
        self._wanted, self._total, self.held = wanted, 0, []

    def add(self, place: tuple, cost: float | Decimal) -> None:
        """Takes a job; ``place`` orders the jobs."""
        if self.reached() and self.held and place > self.held[-1][0]:
            return
        bisect.insort(self.held, (place, cost), key=lambda job: job[0])
        self._total += cost
        while self._total - self.held[-1][1] >= self._wanted:
            self._total -= self.held.pop()[1]

    def reached(self) -> bool:
        return self._total >= self._wanted

    def crossing(self) -> tuple[tuple, float | Decimal, float | Decimal]:
        """The place of the last job held, the costs before it, and its own."""
        *earlier, (place, cost) = self.held
        return place, sum(job[1] for job in earlier), cost


def stream_spend(
    jobs: DataFrame,
    window: str = "1 day",
    slide: str | None = None,
    late: str = "1 hour",
    user_column: str = "user_id",
    started_column: str = "started_at",
) -> DataFrame:
    """Spend per user and time window; records later than the watermark are dropped."""
    span = F.window(started_column, window, slide) if slide else F.window(started_column, window)
    return (
        jobs.withColumn("_cost", billed_cost(jobs))
        .withWatermark(started_column, late)
        .groupBy(span.alias("span"), user_column)
        .agg(F.sum("_cost").alias("spend"), F.count("*").alias("jobs"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), user_column, "spend", "jobs")
    )


def stream_job_metrics(
    jobs: DataFrame,
    window: str = "1 day",
    late: str = "1 hour",
    profile_column: str = "profile_id",
    started_column: str = "started_at",
    id_column: str = "job_id",
    duration: str = "duration_seconds",
) -> DataFrame:
    """Cost and duration per profile and window, every job counted once."""
    return (
        jobs.withColumn("_cost", billed_cost(jobs))
        .withWatermark(started_column, late)
        .dropDuplicatesWithinWatermark([id_column])
        .groupBy(F.window(started_column, window).alias("span"), profile_column)
        .agg(F.sum("_cost").alias("cost"), F.sum(duration).alias("seconds"), F.count("*").alias("jobs"))
        .select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), profile_column, "cost", "seconds", "jobs")
    )


def closing_record(jobs: DataFrame, started_column: str, after: str = "10 days") -> DataFrame:
    """One row that is empty but for a time ``after`` the last one.

    Appended to a source that ends, it moves the watermark past all windows of the jobs, so
    that a last run writes those still open.
    """
    last = jobs.agg((F.max(started_column) + F.expr(f"INTERVAL {after}")).alias("_last"))
    kinds = dict(jobs.dtypes)
    return last.select(*[(F.col("_last") if c == started_column else F.lit(None)).cast(kinds[c]).alias(c) for c in jobs.columns])


def write_closed(result: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append windows to Parquet files once the watermark has passed them."""
    return (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
