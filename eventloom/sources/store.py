"""The event store: Parquet, partitioned by writing batch, id slot and event date.

A batch owns its `batch_id` folder and replaces it as a whole, so replaying it,
even with fewer rows, leaves only what the replay holds.  The slot is a function
of the id (`functions.ids.id_slot`), so copies of an event share it under
whatever day they come, and the duplicate check reads the slots of the batch
only.  Partitioning by date lets time slices and retention touch only the days
they concern.  Files carry Bloom filters on the id, by which lookups skip row
groups.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.ids import id_slot
from eventloom.functions.jsonmerge import merged
from eventloom.model import DEAD_LETTER, EVENT, EVENT_COLUMNS, PROPERTIES
from eventloom.settings import Settings
from eventloom.sources.folders import Folders


class NotFoundError(LookupError):
    """A point lookup found nothing."""


SLOT = ["id_slot", "event_date"]
STORED = T.StructType(
    [
        *EVENT.fields,
        T.StructField("batch_id", T.LongType()),
        T.StructField("id_slot", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)
# Adaptive filters take the size that a row group's ids need.
ID_FILTER = {
    "parquet.bloom.filter.enabled#event_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}
_DEAD = T.StructType([*DEAD_LETTER.fields, T.StructField("batch_id", T.LongType())])


# --- writing ------------------------------------------------------------------


def first_copies(events: DataFrame, order: str | None = None) -> DataFrame:
    """One row per event id, the first by `order`.

    The aggregate combines before its shuffle, so any number of copies of an
    event reaches its task as one row per input partition.
    """
    row = F.struct(*EVENT_COLUMNS)
    if order is None:
        first = F.min(row)
    else:
        first = F.min_by(row, F.struct(order))
    return events.groupBy("event_id").agg(first.alias("_row")).select("_row.*")


def append_events(
    events: DataFrame,
    path: str,
    batch_id: int,
    order: str | None = None,
    days: tuple[date, date] | None = None,
) -> None:
    """Store the events whose ids are not stored yet, under whatever day.

    Only the slots that the batch's ids belong to are searched: at most one per
    day of receipt and a few for other ids, so their list is small.  A caller who
    knows that copies of an event share its time, as redeliveries of one message
    do, may pass the first and last day of the batch as `days`: then only those
    days of the slots are searched.
    """
    fresh = first_copies(events, order).withColumns(
        {"id_slot": id_slot(F.col("event_id")), "event_date": F.to_date("timestamp")}
    )
    earlier = existing_table(events.sparkSession, path, STORED)
    if earlier is None:
        replace_events(fresh, path, batch_id)
        return
    fresh = fresh.persist()  # read twice: for its slots, and to be stored
    try:
        slots = [row.id_slot for row in fresh.select("id_slot").distinct().collect()]
        earlier = known_ids(earlier, slots, days).where(F.col("batch_id") != batch_id)
        replace_events(fresh.join(earlier, ["id_slot", "event_id"], "left_anti"), path, batch_id)
    finally:
        fresh.unpersist()


def known_ids(stored: DataFrame, slots: list[str], days: tuple[date, date] | None = None) -> DataFrame:
    """Stored ids with their slot and batch; other slots, and other days than given, are not read."""
    stored = stored.where(F.col("id_slot").isin(slots))
    if days is not None:
        stored = stored.where(F.col("event_date").between(*days))
    return stored.select("id_slot", "event_id", "batch_id")


def replace_events(events: DataFrame, path: str, batch_id: int) -> None:
    """Make `events`, with their slot and date, all that a batch holds."""
    kept = events.select(*EVENT_COLUMNS, *SLOT)
    replace_batch(kept, path, batch_id, SLOT, ["project_id", "timestamp"], ID_FILTER)


def append_dead_letters(letters: DataFrame, path: str, batch_id: int) -> None:
    replace_batch(letters, path, batch_id)


def replace_batch(
    rows: DataFrame,
    path: str,
    batch_id: int,
    partitions: list[str] | None = None,
    cluster: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> None:
    """Replace this batch's folder, with files of an even size.

    The new folder is written beside (readers of the store skip names that begin
    with `_`) and swapped in when it is complete, so a run that breaks off leaves
    the old one.
    """
    path = path.rstrip("/")
    beside = f"{path}/_staged-{uuid.uuid4().hex}"
    evenly(rows, partitions, cluster, options).parquet(beside)
    Folders(rows.sparkSession).swap_in(beside, f"{path}/batch_id={int(batch_id)}")


def evenly(
    rows: DataFrame,
    partitions: list[str] | None = None,
    cluster: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> DataFrameWriter:
    """A writer of files of an even size.

    The rebalance hint lets adaptive execution split a large partition over several
    files and merge small ones.  Files sorted by `cluster` have narrow row-group
    statistics for it, so reads by those columns skip most of a file.
    """
    by = [*(partitions or []), *(cluster or [])]
    even = rows.hint("rebalance", *(partitions or []))
    even = even.sortWithinPartitions(*by) if by else even
    writer = even.write.options(**(options or {}))
    return writer.partitionBy(*partitions) if partitions else writer


def existing_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# --- reading ------------------------------------------------------------------


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All stored events; empty when nothing has been stored."""
    stored = existing_table(spark, path, STORED)
    return spark.createDataFrame([], STORED) if stored is None else stored


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    stored = existing_table(spark, path, _DEAD)
    return spark.createDataFrame([], _DEAD) if stored is None else stored


def project_page(events: DataFrame, project_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a project's events, oldest first."""
    return (
        events.where(F.col("project_id") == project_id)
        .select(*EVENT_COLUMNS)
        .orderBy("timestamp", "event_id")
        .offset(offset)
        .limit(limit)
    )


def page_after(
    events: DataFrame, project_id: str, after: tuple[datetime, str] | None = None, limit: int = 100
) -> DataFrame:
    """The page behind an event, given by its time and id: no row before it is sorted or moved."""
    own = events.where(F.col("project_id") == project_id)
    if after is not None:
        at, event_id = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        later = (F.col("timestamp") > at) | ((F.col("timestamp") == at) & (F.col("event_id") > event_id))
        own = own.where((F.col("event_date") >= F.to_date(at)) & later)
    return own.select(*EVENT_COLUMNS).orderBy("timestamp", "event_id").limit(limit)


def event_by_id(events: DataFrame, event_id: str, settings: Settings | None = None) -> DataFrame:
    """The event of an id, from the one slot that it belongs to.

    With `settings`, only the days it may lie on are read as well: an id given by
    this engine carries the time of receipt, and an accepted event lies within the
    acceptance window around it.  Without `settings`, ids from elsewhere are found
    as well, by the Bloom filters of their slot's files.
    """
    found = events
    if settings is not None:
        received = datetime.fromtimestamp(int(event_id.replace("-", "")[:12], 16) / 1000, timezone.utc)
        first = received - timedelta(days=settings.max_age_days)
        last = received + timedelta(minutes=settings.max_future_minutes, milliseconds=1)
        found = found.where(F.col("event_date").between(first.date(), last.date()))
    found = found.where((F.col("id_slot") == id_slot(F.lit(event_id))) & (F.col("event_id") == event_id))
    return found.select(*EVENT_COLUMNS)


def get_event(events: DataFrame, event_id: str):
    """The event as a row; raises `NotFoundError` when there is none."""
    found = event_by_id(events, event_id).first()
    if found is None:  # fixed value: the text reported for an unknown id
        raise NotFoundError(f"Event by id {event_id} not found")
    return found


def time_slice(events: DataFrame, start: Column, end: Column, event_type: str | None = None) -> DataFrame:
    """Events of `[start, end)`; other days are not read."""
    day = F.col("event_date")
    kept = events.where(
        day.between(F.to_date(start), F.to_date(end))
        & (F.col("timestamp") >= start)
        & (F.col("timestamp") < end)
    )
    return kept if event_type is None else kept.where(F.col("event_type") == event_type)


def decode_stored(rows: DataFrame) -> DataFrame:
    """Rows whose `properties` are JSON text, as typed events.

    A text that is no object, or has a value that its column can't hold, fails the read instead of becoming null;
    `stored_problems` finds such rows without failing.
    """
    problem = stored_problem(F.col("properties"))
    message = F.concat(F.lit("Stored event "), F.col("event_id"), F.lit(": "), problem)
    typed = F.from_json("properties", PROPERTIES)
    return rows.withColumn("properties", F.when(problem.isNull(), typed).otherwise(F.raise_error(message)))


def stored_problems(rows: DataFrame) -> DataFrame:
    """The rows that can't be read, with their `problem`."""
    problem = stored_problem(F.col("properties"))
    return rows.withColumn("problem", problem).where(problem.isNotNull())


def stored_problem(text: Column) -> Column:
    """What a JSON text of properties has that its columns can't hold; null if nothing."""
    given = F.from_json(text, T.StructType([T.StructField(x.name, T.StringType()) for x in PROPERTIES]))
    typed = F.from_json(text, PROPERTIES)
    lost = [
        F.when(given[x.name].isNotNull() & typed[x.name].isNull(), F.lit(x.name)) for x in PROPERTIES
    ]
    whole = [
        F.when(given[x.name].isNotNull() & ~given[x.name].rlike(r"\A-?\d+\z"), F.lit(x.name))
        for x in PROPERTIES
        if isinstance(x.dataType, (T.LongType, T.IntegerType))
    ]
    no_object = ~F.trim(text).startswith("{") | F.try_parse_json(text).isNull()
    names = F.array_distinct(F.array_compact(F.array(*lost, *whole)))
    return F.when(text.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(no_object, F.lit("properties are no object")).when(
            F.size(names) > 0, F.concat(F.lit("unreadable "), F.array_join(names, ", "))
        )
    )


# --- one-off: legacy layout ---------------------------------------------------


def fold_legacy_columns(rows: DataFrame) -> DataFrame:
    """Fold `user_properties` and `device` into `properties`; ids become text."""
    return rows.withColumns(
        {
            "properties": merged(F.col("properties"), F.col("user_properties"), F.col("device")),
            "user_id": F.col("user_id").cast("string"),
            "session_id": F.col("session_id").cast("string"),
            "event_type": F.col("event_type").cast("string"),
        }
    ).drop("user_properties", "device")
