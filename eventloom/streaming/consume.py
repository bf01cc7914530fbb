"""Consuming the event log into the store.

Read, store, commit: Spark records a micro-batch as done only after its function
returns, so a failed one is replayed.  Replays are harmless because every write
is addressed by the micro-batch's id.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.wire import ORPHAN, dead_letters, decode_messages, decoded_events
from eventloom.plans.spread import spread
from eventloom.sources.store import append_dead_letters, append_events


def observed(messages: DataFrame) -> DataFrame:
    """Count what passes, per micro-batch, for the query's progress reports."""
    size = F.length(F.coalesce("data", F.lit(b"")))
    return messages.observe(
        "worker", F.count("*").alias("messages"), F.count_if(size == 0).alias("empty_messages")
    )


def store_batch(
    messages: DataFrame, batch_id: int, store: str, dead_letter_store: str, projects: DataFrame | None = None
) -> None:
    """Decode one micro-batch; store its events and its dead letters.

    With `projects` given, events of unknown projects become dead letters
    instead of failing the batch.
    """
    decoded = decode_messages(spread(messages))
    if projects is not None:
        decoded = _mark_orphans(decoded, projects)
    decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        append_events(decoded_events(decoded), store, batch_id, order="msg_id")
        append_dead_letters(dead_letters(decoded), dead_letter_store, batch_id)
    finally:
        decoded.unpersist()


def _mark_orphans(decoded: DataFrame, projects: DataFrame) -> DataFrame:
    known = projects.select(F.col("project_id").alias("_known")).distinct()
    joined = decoded.join(known, F.col("event.project_id") == F.col("_known"), "left")
    orphan = F.col("error").isNull() & F.col("_known").isNull()
    message = F.concat(F.lit("Project by id "), F.col("event.project_id"), F.lit(" not found"))
    return joined.withColumns(
        {
            "error_type": F.when(orphan, ORPHAN).otherwise(F.col("error_type")),
            "error": F.when(orphan, message).otherwise(F.col("error")),
        }
    ).drop("_known")


def consume(
    messages: DataFrame,
    store: str,
    dead_letter_store: str,
    checkpoint: str,
    projects: DataFrame | None = None,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Start consuming; `trigger` as in `DataStreamWriter.trigger`."""

    def store_one(batch: DataFrame, batch_id: int) -> None:
        store_batch(batch, batch_id, store, dead_letter_store, projects)

    return start(observed(messages), store_one, checkpoint, trigger)


def start(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def without_duplicates(events: DataFrame, max_age_days: int = 30) -> DataFrame:
    """Streaming alternative to the store's duplicate check, with bounded state.

    An id is remembered for as long as the acceptance window is wide.  Age is
    counted by `created_at`, the time of receipt: a sender sets `timestamp`, and a
    single event from the far future would make all others late.  Start the query
    within `streaming.state.state_on_disk`, so that a month of ids need not fit into
    memory; rows that come too late are counted in the health reports.
    """
    return events.withWatermark("created_at", f"{max_age_days} days").dropDuplicatesWithinWatermark(
        ["event_id"]
    )
