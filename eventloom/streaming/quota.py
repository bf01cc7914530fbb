"""Quotas over a stream of requests.

Each micro-batch is judged by the batch operators, with what earlier batches
left behind: the requests already admitted per open window (fixed windows) or the
windows still open and their use (anchored windows).  That state is a table with
one row per identity and window, written under the batch's id, so it survives
the loss of any process, a replay rewrites it, and a busy identity is metered by
many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators.quota import admit, anchor_windows, clock_window
from eventloom.settings import Settings
from eventloom.sources.store import existing_table

GROUP = ["identity", "window_start"]
ORDER = ["received_at", "request_id"]
_BATCH = T.StructField("batch_id", T.LongType())
_LEDGER = T.StructType(
    [
        T.StructField("identity", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("used", T.LongType()),
        T.StructField("window_day", T.DateType()),
        _BATCH,
    ]
)


def quota_batch(
    requests: DataFrame,
    batch_id: int,
    decisions: str,
    ledger: str,
    settings: Settings,
    anchored: bool = False,
) -> None:
    """Judge one micro-batch of requests that carry `identity` and `quota`.

    Writes the requests with `admitted`, and the admitted count per window.
    """
    spark = requests.sparkSession
    seconds = settings.quota_window_seconds
    earlier = existing_table(spark, ledger, _LEDGER)
    if earlier is None:
        earlier = spark.createDataFrame([], _LEDGER)
    else:
        # Only windows that can still matter to these requests.
        first = requests.agg(F.min("received_at")).first()[0]
        # a micro-batch may be empty, or have no time at all
        floor = F.lit(first).cast("timestamp") - F.make_dt_interval(secs=F.lit(2 * seconds))
        earlier = earlier.where(
            (F.col("window_day") >= F.to_date(floor))
            & (F.col("batch_id") < batch_id)
            & (F.col("window_start") > floor)
        )
    used = earlier.groupBy(*GROUP).agg(F.sum("used").alias("_used"))

    if anchored:
        opened = used.groupBy("identity").agg(
            F.unix_millis(F.max("window_start")).alias("opened")
        )
        windowed = anchor_windows(requests, seconds, opened)
    else:
        windowed = requests.withColumn("window_start", clock_window(F.col("received_at"), seconds))
    remaining = windowed.join(used, GROUP, "left").withColumn(
        "_left", F.greatest(F.col("quota") - F.coalesce("_used", F.lit(0)), F.lit(0))
    )
    judged = admit(remaining, GROUP, ORDER, "_left").drop("_used", "_left")

    _write(judged, decisions, batch_id, [])
    written = read_decisions(spark, decisions, judged.schema).where(F.col("batch_id") == batch_id)
    use = (
        written.where(F.col("identity").isNotNull())
        .groupBy(*GROUP)
        .agg(F.count_if("admitted").alias("used"))
    )
    dated = use.withColumn("window_day", F.to_date("window_start"))
    _write(dated, ledger, batch_id, ["window_day"])


def read_decisions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What `quota_batch` has written of requests with this schema; an empty micro-batch writes no file."""
    return spark.read.schema(T.StructType([*schema.fields, _BATCH])).parquet(path)


def _write(rows: DataFrame, path: str, batch_id: int, partitions: list[str]) -> None:
    (
        rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id")
        .parquet(path)
    )
