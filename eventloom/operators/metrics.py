"""Operational numbers: counts, errors, lag, durations and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import DURATION_BUCKETS


def processed_total(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("events_processed"))


# Fixed value: error type of a micro-batch that failed as a whole.
BATCH_FAILED = "batch_processing_failed"


def errors_by_type(letters: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Dead letters by type; with `failures` (a row per failed micro-batch), these as well."""
    types = letters.select("error_type")
    if failures is not None:
        types = types.unionByName(failures.select(F.lit(BATCH_FAILED).alias("error_type")))
    return types.groupBy("error_type").agg(F.count("*").alias("errors"))


def batch_durations(reports: DataFrame) -> DataFrame:
    """Cumulative histogram of how long micro-batches took, from the health reports."""
    return histogram_le(reports, F.col("duration_seconds"))


def dead_letter_size(letters: DataFrame) -> DataFrame:
    return letters.agg(F.count("*").alias("dlq_size"))


def consumer_lag(appended: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages on the log that have not been consumed, where they are known by their ids only."""
    unread = appended.select("msg_id").join(processed.select("msg_id"), "msg_id", "left_anti")
    return unread.agg(F.count("*").alias("lag"))


def lag_by_marks(appended: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages on the log that have not been consumed, by high-water marks.

    Both have `source` (a partition or file of the log) and `offset`, counted from 0 within it, and are read in this order;
    what remains is the distance of the marks, so no message is looked up.  Either may also be the marks themselves.
    """
    ends = appended.groupBy("source").agg(F.max("offset").alias("_end"))
    marks = processed.groupBy("source").agg(F.max("offset").alias("_mark"))
    both = ends.select("source", "_end", F.lit(None).cast("long").alias("_mark")).unionByName(
        marks.select("source", F.lit(None).cast("long").alias("_end"), "_mark")
    )
    behind = both.groupBy("source").agg(
        F.greatest(F.coalesce(F.max("_end"), F.lit(-1)) - F.coalesce(F.max("_mark"), F.lit(-1)), F.lit(0)).alias("_n")
    )
    return behind.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("lag"))


def histogram_le(df: DataFrame, value: Column, bounds: list[float] = DURATION_BUCKETS) -> DataFrame:
    """Cumulative histogram: rows per upper bound, then `+Inf`, with sum and count.

    One conditional count per bound in a single pass; the rows are not multiplied.
    """
    labels = [str(bound) for bound in bounds] + ["+Inf"]
    totals = df.agg(
        *[F.count_if(value <= bound).alias(f"_{n}") for n, bound in enumerate(bounds)],
        F.count(value).alias("count"),
        F.sum(value).alias("sum"),
    )
    counts = [F.col(f"_{n}") for n in range(len(bounds))] + [F.col("count")]
    buckets = F.array(
        *[F.struct(F.lit(label).alias("le"), n.alias("n")) for label, n in zip(labels, counts)]
    )
    return totals.select(F.inline(buckets), "count", "sum")


def delivered_throughput(requests: DataFrame, at: Column, events: Column) -> DataFrame:
    """Events delivered per second: a single request counts 1, a batch its size."""
    return requests.groupBy(F.date_trunc("second", at).alias("second")).agg(
        F.count("*").alias("requests"), F.sum(events).alias("events")
    )


def steady_state_rate(samples: DataFrame, warm_up_seconds: int) -> DataFrame:
    """Mean step of a cumulative counter, and mean latency, after the warm-up.

    `samples` has `at`, `total` (cumulative) and `latency`.  The steps between
    successive samples add up to last minus first, so no ordering is needed.
    """
    begin = samples.agg(F.min("at")).scalar()
    stable = samples.where(
        F.unix_micros("at") > F.unix_micros(begin) + F.lit(warm_up_seconds * 1_000_000)
    )
    steps = F.count("*") - 1
    rise = F.max_by("total", "at") - F.min_by("total", "at")
    return stable.agg(
        F.try_divide(rise, steps).alias("average_rate"), F.avg("latency").alias("average_latency")
    )
