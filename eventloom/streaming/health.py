"""Health of running queries: their progress reports, and gauges taken from time to time.

Both are tables that a listener appends to, so nothing is lost however long a query runs.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.listener import QueryProgressEvent, StreamingQueryProgress

from eventloom.sources.folders import Folders

HEALTH = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("reported_at", T.StringType()),
        T.StructField("input_rows", T.LongType()),
        T.StructField("messages", T.LongType()),
        T.StructField("empty_messages", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("behind_offsets", T.StringType()),
    ]
)

# With what the query's state holds, and the rows that came too late for it.
REPORT = T.StructType(
    [*HEALTH.fields, T.StructField("state_rows", T.LongType()), T.StructField("late_rows", T.LongType())]
)

GAUGE = T.StructType(
    [
        T.StructField("taken_at", T.StringType()),
        T.StructField("lag", T.LongType()),
        T.StructField("dlq_size", T.LongType()),
    ]
)

FAILURE = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("failed_at", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


def health_rows(spark: SparkSession, progresses: Iterable[StreamingQueryProgress]) -> DataFrame:
    """One row per report: rows, observed counts, duration and source backlog.

    Spark keeps a bounded number of reports per query
    (`spark.sql.streaming.numRecentProgressUpdates`).
    """
    return spark.createDataFrame([_row(progress) for progress in progresses], REPORT)


def _row(progress: StreamingQueryProgress) -> tuple:
    seen = progress.observedMetrics.get("worker")
    backlog = {name: value for source in progress.sources for name, value in source.metrics.items()}
    return (
        str(progress.id),
        progress.batchId,
        progress.timestamp,
        progress.numInputRows,
        seen.messages if seen else None,
        seen.empty_messages if seen else None,
        progress.durationMs.get("triggerExecution", 0) / 1000,
        backlog.get("maxOffsetsBehindLatest"),
        sum(operator.numRowsTotal for operator in progress.stateOperators),
        sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators),
    )


class HealthLog(StreamingQueryListener):
    """Appends every report of every query to a table, as it arrives.

    With `failures`, a query that a failing micro-batch ends adds a row there.  With `gauges`, a path and a function
    that gives lag and dead-letter size, these are taken when a report arrives, or a query is idle, and `every` seconds
    have passed since the last time.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        failures: str | None = None,
        gauges: tuple[str, Callable[[], tuple[int, int]]] | None = None,
        every: float = 15.0,
    ) -> None:
        self._spark = spark
        self._path = path
        self._failures = failures
        self._gauges = gauges
        self._every = every
        self._taken = -math.inf

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        health_rows(self._spark, [event.progress]).coalesce(1).write.mode("append").parquet(self._path)
        self._take()

    def onQueryIdle(self, event) -> None:
        self._take()

    def onQueryTerminated(self, event) -> None:
        if self._failures and event.exception:
            row = (str(event.id), datetime.now(timezone.utc).isoformat(), event.exception)
            self._spark.createDataFrame([row], FAILURE).write.mode("append").parquet(self._failures)

    def _take(self) -> None:
        if self._gauges and time.monotonic() - self._taken >= self._every:
            path, take = self._gauges
            row = (datetime.now(timezone.utc).isoformat(), *take())
            self._spark.createDataFrame([row], GAUGE).coalesce(1).write.mode("append").parquet(path)
            self._taken = time.monotonic()


def reported(spark: SparkSession, path: str) -> DataFrame:
    """What a `HealthLog` has written, one row per micro-batch: a replayed one reports again."""
    rows = spark.read.schema(REPORT).parquet(path)
    last = F.max_by(F.struct(*REPORT.fieldNames()), "reported_at").alias("_row")
    return rows.groupBy("query_id", "batch_id").agg(last).select("_row.*")


def committed_files(spark: SparkSession, checkpoint: str, source: int = 0) -> DataFrame:
    """The files of a query's file source that committed micro-batches have read, from its logs: `path`."""
    committed = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select(
        F.max(F.regexp_extract("path", r"/([0-9]+)$", 1).try_cast("long")).alias("_last")
    )
    entries = spark.read.text(f"{checkpoint}/sources/{source}").where(F.col("value").startswith("{"))
    entry = F.from_json("value", "path string, batchId long")
    read = entries.select(entry.alias("_e")).select("_e.*")
    return read.where(F.col("batchId") <= committed.scalar()).select("path").distinct()


def unread(rows: DataFrame, checkpoint: str, source: int = 0) -> DataFrame:
    """How many of the rows of a file source (a batch read of the same folder) its query has not committed yet: `lag`.

    Rows are counted file by file before what the logs name is taken off; without a commit all are unread.
    """
    spark = rows.sparkSession
    files = rows.groupBy(_plain(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("_n"))
    if Folders(spark).exists(f"{checkpoint}/commits"):
        done = committed_files(spark, checkpoint, source).select(_plain(F.col("path")).alias("path"))
        files = files.join(done, "path", "left_anti")
    return files.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("lag"))


def _plain(path: Column) -> Column:
    """`file:///a` and `file:/a` name the same file."""
    return F.regexp_replace(path, "^([a-z]+):/+", "$1:/")


def late_drops(reports: DataFrame) -> DataFrame:
    """Rows that came too late for a query's state and were dropped."""
    return reports.groupBy("query_id").agg(F.sum("late_rows").alias("late_rows"), F.max("state_rows").alias("state_rows"))


def backlog(health: DataFrame) -> DataFrame:
    """Latest report of each query."""
    return health.groupBy("query_id").agg(
        F.max("batch_id").alias("batch_id"),
        F.sum("input_rows").alias("input_rows"),
        F.max_by("behind_offsets", "batch_id").alias("behind_offsets"),
    )
