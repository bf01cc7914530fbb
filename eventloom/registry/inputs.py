"""The engine's inputs, derived row by row from the given `events` and `nation` tables.

The mapping is stated in FIXTURES.md; `registry.oracle` states it again in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.model import EVENT_COLUMNS, PROPERTIES
from eventloom.operators.wire import encode_events
from eventloom.plans.ingest import accepted_events, outcomes
from eventloom.plans.scratch import fresh_path
from eventloom.plans.spread import ROWS_PER_TASK, spread, tasks_for
from eventloom.settings import Settings
from eventloom.sources.store import append_events, read_events

AS_OF = "2024-01-31 00:00:00"
SETTINGS = Settings(environment="test")

# Envelopes are cut at multiples of this many source rows, so that no envelope
# grows with the data however large a user's share of it.
ENVELOPE_SPAN = 10_000


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_mapping(spread(events, events.count()))


def with_mapping(events: DataFrame) -> DataFrame:
    """Add the mapped columns: `k`, `mapped_type`, `session_id`, `batch`, `api_key`, `fault`."""
    n, k, user = F.col("event_id"), F.col("k"), F.col("user_id")
    session = F.concat(F.lit("user_"), user, F.lit("_"), F.date_format("ts", "yyyyMMdd"))
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        .withColumns(
            {
                "mapped_type": F.when(
                    F.col("event_type") == "view",
                    F.when(k % 2 == 0, "page_view").otherwise("product_view"),
                )
                .when(
                    F.col("event_type") == "click",
                    F.when(k % 4 == 0, "remove_from_cart").otherwise("add_to_cart"),
                )
                .when(F.col("event_type") == "purchase", "purchase")
                .when(F.col("event_type") == "signup", "page_view")
                .otherwise("product_view"),
                "session": session,
                "batch": F.concat(session, F.lit("_"), F.floor(n / ENVELOPE_SPAN)),
                "api_key": F.when(user % 40 == 7, "wk_test_unknown")
                .when(user % 40 == 11, F.lit(None))
                .when(user % 40 == 13, "pk_live_x")
                .otherwise(F.concat(F.lit("wk_test_"), user % 25)),
                "fault": F.when(n % 5 == 0, F.floor(n / 5) % 6),
            }
        )
    )


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (index + 1).cast("int"))


def property_columns() -> dict[str, Column]:
    k = F.col("k")
    return {
        "page_url": F.concat(F.lit("https://shop.example.com/p/"), k),
        "product_id": F.when(
            F.col("mapped_type") != "page_view", F.format_string("prod_%04d", k)
        ),
        "category": F.concat(F.lit("category_"), k % 6),
        "price": F.greatest(F.col("value"), F.lit(0.01)),
        "quantity": k % 10 + 1,
        "currency": _pick(k % 3, ["USD", "EUR", "GBP"]),
        "country": _pick(k % 5, ["US", "GB", "DE", "FR", "JP"]),
        "device_type": _pick(k % 3, ["mobile", "desktop", "tablet"]),
    }


def raw_time() -> Column:
    hour, days = F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 60 DAYS")
    return (
        F.when(F.col("fault") == 2, as_of() + hour)
        .when(F.col("fault") == 3, as_of() - days)
        .otherwise(F.col("ts"))
    )


def raw_bodies(mapped: DataFrame) -> DataFrame:
    """Add `raw`, the JSON text a sender would post, with its faults."""
    fault = F.coalesce("fault", F.lit(-1))
    columns = property_columns()
    kept = {name: F.when(fault != 4, column) for name, column in columns.items()}
    kept["page_url"] = columns["page_url"]
    kept["price"] = F.when(fault == 5, F.lit(-100.0)).otherwise(kept["price"])
    event_type = (
        F.when(fault == 0, F.lit(None))
        .when(fault == 1, "INVALID_TYPE")
        .when(fault.isin(4, 5), "purchase")
        .otherwise(F.col("mapped_type"))
    )
    record = F.struct(
        F.concat(F.lit("user_"), F.col("user_id")).alias("user_id"),
        F.col("session").alias("session_id"),
        event_type.alias("event_type"),
        F.date_format(raw_time(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.struct(*[column.alias(name) for name, column in kept.items()]).alias("properties"),
    )
    return mapped.withColumn("raw", F.to_json(record))


def _request(request_id: Column, kind: str, received_at: Column, body: Column) -> list[Column]:
    return [
        request_id.alias("request_id"),
        F.lit(kind).alias("kind"),
        F.col("api_key"),
        F.lit(None).cast("string").alias("forwarded_for"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 16).alias("client_ip"),
        received_at.alias("received_at"),
        body.alias("body"),
    ]


def single_requests(mapped: DataFrame) -> DataFrame:
    """Every event as its own request, received at the as-of time."""
    return raw_bodies(mapped).select(
        *_request(F.col("event_id").cast("string"), "single", as_of(), F.col("raw"))
    )


def batch_requests(mapped: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Events of a user's day in one envelope, in source order; `raw` may have other texts of the events."""
    raw = raw_bodies(mapped) if raw is None else raw
    grouped = raw.groupBy("batch", "api_key", "user_id").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "raw"))).alias("_raws")
    )
    texts = F.array_join(F.transform("_raws", lambda entry: entry.raw), ",")
    body = F.concat(F.lit('{"events":['), texts, F.lit("]}"))
    return grouped.select(*_request(F.col("batch"), "batch", as_of(), body))


def metered_requests(mapped: DataFrame) -> DataFrame:
    """Every event as a request received at its own time, without a body."""
    return mapped.select(
        *_request(F.col("event_id").cast("string"), "single", F.col("ts"), F.lit("{}"))
    )


def project_id(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    return nation.select(
        project_id(key).alias("project_id"),
        F.col("n_name").alias("name"),
        _pick(key % 3, ["free", "pro", "enterprise"]).alias("plan"),
        F.concat(F.lit("wk_test_"), key).alias("api_key"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"),
    )


def typed_events(mapped: DataFrame) -> DataFrame:
    """Every event as it would stand on the log, faults aside."""
    given = property_columns()
    given["price"] = F.rint(given["price"] * 100).cast("long")
    properties = F.struct(
        *[
            given.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in PROPERTIES
        ]
    )
    values = {
        "event_id": project_id(F.col("event_id")),
        "project_id": project_id(F.col("user_id") % 25),
        "user_id": F.concat(F.lit("user_"), F.col("user_id")),
        "session_id": F.col("session"),
        "event_type": F.col("mapped_type"),
        "timestamp": F.col("ts"),
        "properties": properties,
        "created_at": as_of(),
    }
    return mapped.select(
        *[values[name].alias(name) for name in EVENT_COLUMNS], F.col("event_id").alias("number")
    )


def messages(mapped: DataFrame) -> DataFrame:
    """The event log: encoded events, some twice, some malformed, some empty."""
    typed = typed_events(mapped)
    number = F.col("number")
    copies = F.when(number % 20 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    encoded = encode_events(typed).select(
        F.substring("event_id", -12, 12).cast("long").alias("number"), "data"
    )
    data = (
        F.when(number % 50 == 9, F.lit("not_json"))
        .when(number % 50 == 19, F.lit(""))
        .otherwise(F.col("data"))
    )
    return encoded.select(number, data.alias("data"), F.explode(copies).alias("copy")).select(
        F.concat_ws("-", "number", "copy").alias("msg_id"), F.encode("data", "utf-8").alias("data")
    )


# The days that the parts of the streamed log begin on.
STREAM_PARTS = ["2024-01-08", "2024-01-16", "2024-01-24"]

# Events in a file of such a part.
PART_FILE_ROWS = 1_000_000

_streamed: dict[tuple[str, str], tuple[str, int, int]] = {}


def stream_part(ts: Column) -> Column:
    """The number of the part an event comes in, which is its micro-batch."""
    return sum((F.when(ts >= F.lit(day).cast("timestamp"), 1).otherwise(0) for day in STREAM_PARTS), F.lit(0))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of several micro-batches, in order of time.

    Its parts are written one after the other, once per session, and read one per
    micro-batch.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if key not in _streamed:
        path = fresh_path(spark, "streamed")
        _streamed[key] = (path, *write_parts(events, path))
    path, files, most = _streamed[key]
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return with_mapping(spread_stream(reader.parquet(f"{path}/*"), most))


def write_parts(events: DataFrame, path: str) -> tuple[int, int]:
    """Write the parts of the log, all as the same number of files: that number, and the rows of the largest part.

    So a part is one micro-batch whatever its size.  What is missing to the number, as tasks without rows write no
    file, are empty files.
    """
    spark, part = events.sparkSession, stream_part(F.col("ts").cast("timestamp"))
    counts = [row["count"] for row in events.groupBy(part).count().collect()]
    most = max(counts, default=0)
    files = max(1, -(-most // PART_FILE_ROWS))
    none = spark.createDataFrame([], events.schema).coalesce(1)
    for number in range(len(STREAM_PARTS) + 1):
        place = f"{path}/part={number}"
        events.where(part == number).repartition(files).write.parquet(place)
        for _ in range(files - len(spark.read.schema(events.schema).parquet(place).inputFiles())):
            none.write.mode("append").parquet(place)
    return files, most


def spread_stream(files: DataFrame, rows: int) -> DataFrame:
    """A stream of files whose micro-batches have so many rows; large ones are dealt to tasks of a bounded size."""
    return files.repartition(tasks_for(files, rows)) if rows > ROWS_PER_TASK else files


_stored: dict[tuple[str, str], str] = {}


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted single requests in a store, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = fresh_path(spark, "store")
        mapped = events_table(spark, sf_dir)
        judged = outcomes(single_requests(mapped), projects(spark, sf_dir), SETTINGS)
        append_events(accepted_events(judged), path, batch_id=0)
        _stored[key] = path
    return read_events(spark, _stored[key])
