"""Reject records: code, status, message and per-field payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import title_of
from eventloom.model import REJECT_STATUS
from eventloom.settings import Settings


def status_of(code: Column) -> Column:
    """HTTP status of a reject code, null for an unknown code."""
    pairs = [F.lit(part) for pair in REJECT_STATUS.items() for part in pair]
    return F.create_map(*pairs)[code]


def default_message(code: Column) -> Column:
    return title_of(code)


def quota_message(settings: Settings) -> str:
    return f"Rate limit exceeded. Retry after {settings.quota_window_seconds} seconds."


def reject_records(outcomes: DataFrame) -> DataFrame:
    """One record per refused item, or per request that held no item.

    `disposition` is `dropped` for a bad item that its batch survives and
    `rejected` otherwise.
    """
    # A batch's own failures concern its list; a dropped item's are its own.
    dropped = F.col("disposition") == "dropped"
    place = F.when(dropped, F.concat(F.lit("body.events."), F.col("pos"))).otherwise("body")

    def located(error: Column) -> Column:
        return error.withField(
            "loc", F.when(error.loc == "", place).otherwise(F.concat_ws(".", place, error.loc))
        )

    return outcomes.where(F.col("disposition") != "accepted").select(
        "request_id",
        "pos",
        "disposition",
        "code",
        F.coalesce("message", default_message(F.col("code"))).alias("message"),
        status_of(F.col("code")).alias("status"),
        F.transform("errors", located).alias("errors"),
        "received_at",
    )
