"""Raw inputs, in batch and as streams.

Requests and messages arrive as JSON lines or Parquet files with the columns of
`model.REQUEST` / `model.MESSAGE`.  Kafka needs its Spark package on the
classpath; the options are passed through and nothing else changes.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventloom.model import MESSAGE, REQUEST
from eventloom.settings import Settings

FORMATS = ("json", "parquet")


def read_requests(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return _reader(spark.read, format, REQUEST).load(path)


def stream_requests(
    spark: SparkSession, path: str, settings: Settings, format: str = "json"
) -> DataFrame:
    reader = _reader(spark.readStream, format, REQUEST)
    return reader.option("maxFilesPerTrigger", settings.files_per_trigger).load(path)


def read_messages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _reader(spark.read, format, MESSAGE).load(path)


def stream_messages(
    spark: SparkSession, path: str, settings: Settings, format: str = "parquet"
) -> DataFrame:
    """Unread messages from the beginning, at most so many files per micro-batch."""
    reader = _reader(spark.readStream, format, MESSAGE)
    return reader.option("maxFilesPerTrigger", settings.files_per_trigger).load(path)


def kafka_options(servers: str, topic: str, messages_per_trigger: int) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(messages_per_trigger),
    }


def stream_kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Messages of a topic; the message id is the record's partition and offset."""
    records = spark.readStream.format("kafka").options(**options).load()
    return records.select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("msg_id"),
        F.col("value").alias("data"),
    )


def as_messages(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.col("event_id").alias("msg_id"), F.encode("data", "utf-8").alias("data"))


def write_messages(encoded: DataFrame, path: str) -> None:
    """Append encoded events to a file-based log."""
    as_messages(encoded).write.mode("append").parquet(path)


def publish(
    encoded: DataFrame, path: str, checkpoint: str, trigger: dict[str, Any] | None = None
) -> StreamingQuery:
    """Append a stream of encoded events to a file-based log, each micro-batch once."""
    writer = as_messages(encoded).writeStream.format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def publish_kafka(
    encoded: DataFrame, servers: str, topic: str, checkpoint: str, trigger: dict[str, Any] | None = None
) -> StreamingQuery:
    """Append a stream of encoded events to a topic, keyed by event id; a replay may repeat records."""
    records = as_messages(encoded).select(F.col("msg_id").alias("key"), F.col("data").alias("value"))
    writer = records.writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic})
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _reader(reader, format: str, schema: T.StructType):
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return reader.format(format).schema(schema)
