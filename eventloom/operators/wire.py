"""Event log messages: encoding, decoding and what counts as undecodable."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from eventloom.functions.ids import canonical_uuid
from eventloom.functions.times import iso_text, parse_wire_time
from eventloom.model import EVENT_COLUMNS, EVENT_TYPES, PROPERTIES
from eventloom.plans.fence import fenced

# Error types and their prefix in dead letters.
DECODE_ERROR = "deserialization"
EMPTY_MESSAGE = "empty_message_data"
ORPHAN = "orphan_event"
PREFIX = "DeserializationError: "

# The largest numbers that the columns hold exactly.
NUMBERS = {"price": 2**53, "quantity": 2**31 - 1}


def encode_events(events: DataFrame) -> DataFrame:
    """Events to messages: JSON text with every key present, times as ISO text."""
    as_text = {
        "timestamp": iso_text(F.col("timestamp")),
        "created_at": iso_text(F.col("created_at")),
    }
    record = F.struct(*[as_text.get(name, F.col(name)).alias(name) for name in EVENT_COLUMNS])
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return events.select("event_id", text.alias("data"))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Messages to events, with `error` set and `event` null where that fails.

    Keeps the messages' columns and adds `error_type`.  Ranges and text lengths
    were checked before the log and are taken as they are, but a property that is
    there and has not the kind of its column is an error rather than a null.
    """
    failed = messages
    for name, column in _decode_stages():
        failed = failed.withColumn(name, column)
    kept = fenced(failed.drop("_doc", "_f", "_p", "_t", "_has", "_v"), "error", "event")
    kind = F.when(F.col("error") == EMPTY_MESSAGE, EMPTY_MESSAGE).when(F.col("error").isNotNull(), DECODE_ERROR)
    return kept.withColumn("error_type", kind)


@cache
def _decode_stages() -> list[tuple[str, Column]]:
    fields = ",".join(f"`{name}`:variant" for name in EVENT_COLUMNS)
    given = ",".join(f"`{field.name}`:variant" for field in PROPERTIES)
    bad_properties = F.col("_f.properties").isNotNull() & (
        F.try_variant_get("_f.properties", "$", "struct<x:variant>").isNull()
    )
    present = F.struct(
        F.col("_doc").isNotNull().alias("json"),
        F.col("_f").isNotNull().alias("object"),
        bad_properties.alias("bad_properties"),
        *[F.col(f"_f.{name}").isNotNull().alias(name) for name in EVENT_COLUMNS],
    )
    texts = ",".join(f"`{name}`:string" for name in EVENT_COLUMNS if name != "properties")
    values = f"struct<{texts},properties:{PROPERTIES.simpleString()}>"

    def text(name: str) -> Column:
        return F.col(f"_t.{name}")

    read = F.struct(
        canonical_uuid(text("event_id")).alias("event_id"),
        canonical_uuid(text("project_id")).alias("project_id"),
        text("user_id").alias("user_id"),
        text("session_id").alias("session_id"),
        F.when(text("event_type").isin(EVENT_TYPES), text("event_type")).alias("event_type"),
        parse_wire_time(text("timestamp")).alias("timestamp"),
        parse_wire_time(text("created_at")).alias("created_at"),
    )
    # Absent properties read as an empty object.
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in PROPERTIES])
    properties = F.coalesce(text("properties"), nothing)
    # Whole numbers may come with a fraction of zero, which the typed reading refuses.
    numbers = {
        field.name: F.try_variant_get(f"_p.{field.name}", "$", "double").cast(field.dataType)
        for field in PROPERTIES
        if field.name in NUMBERS
    }
    properties = F.when(
        text("properties").isNotNull(),
        F.struct(*[F.coalesce(properties[f.name], numbers.get(f.name, F.lit(None))).alias(f.name) for f in PROPERTIES]),
    ).otherwise(nothing)
    event = F.struct(
        *[
            (properties if name == "properties" else F.col(f"_v.{name}")).alias(name)
            for name in EVENT_COLUMNS
        ]
    )
    return [
        ("_doc", F.try_parse_json(F.col("data").cast("string"))),
        ("_t", F.from_json(F.col("data").cast("string"), values)),
        ("_f", F.try_variant_get("_doc", "$", f"struct<{fields}>")),
        ("_p", F.try_variant_get("_f.properties", "$", f"struct<{given}>")),
        ("_has", present),
        ("_v", read),
        ("error", _decode_error()),
        ("event", F.when(F.col("error").isNull(), event)),
    ]


def _decode_error() -> Column:
    """First thing wrong with a message, in the order it is read."""
    error = (
        F.when(F.length(F.coalesce("data", F.lit(b""))) == 0, EMPTY_MESSAGE)
        .when(~F.col("_has.json"), PREFIX + "message is not valid JSON")
        .when(~F.col("_has.object"), PREFIX + "message is not an object")
        .when(F.col("_has.bad_properties"), PREFIX + "properties is not an object")
    )
    for name in ["timestamp", "created_at", "event_id", "project_id", "event_type"]:
        missing, broken = f"{PREFIX}'{name}'", _broken(name)
        error = error.when(~F.col(f"_has.{name}"), missing).when(
            F.col(f"_v.{name}").isNull(), broken
        )
    for field in PROPERTIES:
        error = error.when(_mistyped(field), f"{PREFIX}properties.{field.name} has the wrong type")
    return error


def _mistyped(field: StructField) -> Column:
    """A property that is there, not null, and no text, or no whole number in range."""
    value = F.col(f"_p.{field.name}")
    kind = F.schema_of_variant(value)
    if field.name not in NUMBERS:
        wrong = kind != "STRING"
    else:
        number = F.try_variant_get(value, "$", "double")
        whole = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number))
        wrong = ~F.coalesce(whole & (F.abs(number) <= NUMBERS[field.name]), F.lit(False))
    return value.isNotNull() & ~F.is_variant_null(value) & wrong


def _broken(name: str) -> Column:
    raw = F.coalesce(F.col(f"_t.{name}"), F.lit("None"))
    if name in ("event_id", "project_id"):
        return F.lit(PREFIX + "badly formed hexadecimal UUID string")
    if name == "event_type":
        return F.concat(F.lit(PREFIX + "'"), raw, F.lit("' is not a valid EventType"))
    return F.concat(F.lit(PREFIX + "Invalid isoformat string: '"), raw, F.lit("'"))


def decoded_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).select("msg_id", "event.*")


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Undecodable and empty messages with their bytes kept as they came."""
    return decoded.where(F.col("error").isNotNull()).select(
        F.col("msg_id").alias("original_msg_id"),
        "error",
        "error_type",
        F.current_timestamp().alias("failed_at"),
        F.col("data").alias("raw_data"),
    )
