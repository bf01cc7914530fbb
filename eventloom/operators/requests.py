"""Requests to items: parsing bodies and opening batch envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.validate import ERROR, failure


def parse_bodies(requests: DataFrame) -> DataFrame:
    """Add `doc`, the parsed body; null when the body is not JSON."""
    return requests.withColumn("doc", F.try_parse_json("body"))


def open_requests(requests: DataFrame) -> DataFrame:
    """One row per item: `pos`, `item`, `item_text`, `raw_items` and `request_errors`.

    A single request is its own only item.  A batch without a usable list gives
    one row whose `request_errors` say why; an empty list gives one row without
    errors and `raw_items` = 0.
    """
    is_batch = F.col("kind") == "batch"
    envelope = F.when(is_batch, F.try_variant_get("doc", "$", "struct<events:variant>"))
    listed = F.try_variant_get("_envelope.events", "$", "array<variant>")
    texts = F.from_json("body", "struct<events:array<string>>").getField("events")
    opened = requests.withColumn("_envelope", envelope).withColumns(
        {
            "_items": F.when(is_batch, listed).otherwise(F.array("doc")),
            "_texts": F.when(is_batch, texts).otherwise(F.array("body")),
        }
    )
    bad_json = F.when(
        F.trim(F.coalesce("body", F.lit(""))) == "", failure("", "missing")
    ).when(F.col("doc").isNull(), failure("", "json_invalid"))
    bad_envelope = (
        F.when(~is_batch, F.lit(None).cast(ERROR))
        .when(F.col("_envelope").isNull(), failure("", "model_attributes_type"))
        .when(F.col("_envelope.events").isNull(), failure("events", "missing"))
        .when(F.col("_items").isNull(), failure("events", "list_type"))
    )
    problem = F.coalesce(bad_json, bad_envelope)
    kept = [name for name in requests.columns if name not in ("body", "doc")]
    # Judged before the list is opened: a column computed from the list after that
    # would carry the whole list along with each of its items.
    judged = opened.select(
        *kept,
        bad_json.isNotNull().alias("unreadable"),
        F.when(problem.isNotNull(), F.array(problem))
        .otherwise(F.array().cast(f"array<{ERROR}>"))
        .alias("request_errors"),
        F.coalesce(F.size("_items"), F.lit(0)).alias("raw_items"),
        F.arrays_zip("_items", "_texts").alias("_pairs"),
    )
    passed = [name for name in judged.columns if name != "_pairs"]
    return judged.select(*passed, F.posexplode_outer("_pairs").alias("pos", "_pair")).select(
        *passed, "pos", F.col("_pair._items").alias("item"), F.col("_pair._texts").alias("item_text")
    )
