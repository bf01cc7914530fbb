"""From raw requests to outcomes: the write path as one lazy plan.

Every item ends with exactly one `disposition`.  When several reasons apply the
order is: unreadable body, quota, field rules, batch size, tenant.  The plan is
row-local but for the tenant lookup, the quota (when it is on) and the size
check, which looks only at bodies long enough to break the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.ids import event_key
from eventloom.model import EVENT_COLUMNS
from eventloom.operators.quota import fixed_window_quota, with_quota_identity
from eventloom.operators.rejects import default_message, quota_message
from eventloom.operators.requests import open_requests, parse_bodies
from eventloom.operators.tenants import resolve_tenants
from eventloom.operators.validate import check_events, failure, is_valid
from eventloom.plans.fence import fenced
from eventloom.settings import Settings

# A valid event cannot be written in fewer characters than its three required
# keys, which bounds the bodies that can hold too many valid events.
_SHORTEST_EVENT = len('{"event_type":"","timestamp":0,"properties":{}}')


def sized_items(requests: DataFrame, settings: Settings) -> DataFrame:
    """Checked items with `oversized`: whether their batch has too many valid ones.

    Only a list longer than the limit can break it, and only a long body can hold
    so many valid events, so all other requests take a branch without a shuffle.
    Every item takes exactly one of the two branches.
    """
    limit = settings.max_batch
    # Body and document are fenced, so that they are computed once; the body's length
    # is not, so the filter on it reaches the unparsed bodies.
    long_body = (F.col("kind") == "batch") & (F.length("body") > _SHORTEST_EVENT * limit)
    long_body = F.coalesce(long_body, F.lit(False))
    sized = fenced(requests, "body").withColumn("long_body", long_body)
    opened = open_requests(fenced(parse_bodies(sized), "doc"))

    # Told apart before the items are checked, which is what takes the time.
    long_list = F.col("long_body") & (F.col("raw_items") > limit)
    computed = ("unreadable", "request_errors", "raw_items", "pos")
    regular = check_events(opened.where(~long_list), settings, computed).withColumn("oversized", F.lit(False))
    # A window holds the items of one body, which one task has opened before.
    valid = F.count_if(is_valid()).over(Window.partitionBy("request_id"))
    long_lists = check_events(opened.where(long_list), settings, computed).withColumn("oversized", valid > limit)
    return regular.unionByName(long_lists).drop("long_body")


def metered(requests: DataFrame, settings: Settings) -> DataFrame:
    """Add `throttled`; requests with an unreadable body are not counted."""
    if not settings.quota_enabled:
        return requests.withColumn("throttled", F.lit(False))
    readable = F.try_parse_json("body").isNotNull()
    identified = with_quota_identity(requests, settings)
    counted = identified.withColumn("identity", F.when(readable, F.col("identity")))
    judged = fixed_window_quota(counted, settings)
    return judged.withColumn("throttled", ~F.col("admitted")).drop(
        "identity", "quota", "window_start", "admitted"
    )


def outcomes(requests: DataFrame, projects: DataFrame, settings: Settings) -> DataFrame:
    """Judge every item: `disposition`, `code`, `message`, `errors` and the `event`."""
    attributed = metered(resolve_tenants(requests, projects, settings), settings)
    checked = sized_items(attributed, settings)

    is_batch = F.col("kind") == "batch"
    request_failed = F.size("request_errors") > 0
    bad_item = ~is_valid()
    # The quota step looks the key up first, so there an unknown key fails early.
    early_tenant = F.lit(settings.quota_enabled) & (F.col("tenant_code") == "NotFoundError")
    empty = is_batch & (F.col("raw_items") == 0)
    reason = (
        F.when(F.col("unreadable"), "body")
        .when(early_tenant, "tenant")
        .when(F.col("throttled"), "quota")
        .when(request_failed, "body")
        .when(empty, "empty")
        .when(is_batch & bad_item, "dropped")
        .when(bad_item, "item")
        .when(F.col("oversized"), "oversized")
        .when(F.col("tenant_code").isNotNull(), "tenant")
        .otherwise("accepted")
    )
    reason_column = F.col("reason")
    too_short = failure(
        "events",
        "too_short",
        f"List should have at least {settings.min_batch} item after validation, not 0",
    )
    too_long = failure(
        "events", "too_long", f"List should have at most {settings.max_batch} items after validation"
    )
    return (
        checked.withColumn("reason", reason)
        .withColumn(
            "code",
            F.when(reason_column == "quota", "RateLimitExceededError")
            .when(reason_column == "tenant", F.col("tenant_code"))
            .when(reason_column != "accepted", "ValidationError"),
        )
        .withColumns(
            {
                "disposition": F.when(reason_column.isin("accepted", "dropped"), reason_column).otherwise(
                    "rejected"
                ),
                "message": F.when(reason_column == "quota", quota_message(settings))
                .when(reason_column == "tenant", F.col("tenant_message"))
                .when(reason_column != "accepted", default_message(F.col("code"))),
                "errors": F.when(reason_column == "body", F.col("request_errors"))
                .when(reason_column == "empty", F.array(too_short))
                .when(reason_column == "oversized", F.array(too_long))
                .when(reason_column.isin("dropped", "item"), F.col("errors"))
                .otherwise(F.slice("errors", 1, 0)),
            }
        )
        .withColumn(
            "event_id",
            F.when(
                reason_column == "accepted",
                event_key(F.col("received_at"), F.col("request_id"), F.col("pos")),
            ),
        )
        .select(
            "request_id",
            "kind",
            "pos",
            "received_at",
            "project_id",
            "plan",
            "disposition",
            "code",
            "message",
            "errors",
            "event_id",
            "event",
        )
    )


def accepted_events(judged: DataFrame) -> DataFrame:
    """Accepted items as events, stamped with id, tenant and ingest time."""
    stamped = {
        "event_id": F.col("event_id"),
        "project_id": F.col("project_id"),
        "created_at": F.col("received_at"),
    }
    return judged.where(F.col("disposition") == "accepted").select(
        *[stamped.get(name, F.col(f"event.{name}")).alias(name) for name in EVENT_COLUMNS]
    )


def receipts(judged: DataFrame) -> DataFrame:
    """One row per request: status, code and the accepted ids in batch order.

    At most `max_batch` ids exist per request, since a larger one is refused.
    """
    accepted = F.col("disposition") == "accepted"
    ids = F.collect_list(F.when(accepted, F.struct("pos", "event_id")))
    refusal = F.max(F.when(F.col("disposition") == "rejected", F.col("code")))
    return (
        judged.groupBy("request_id", "kind")
        .agg(
            F.count_if(accepted).alias("n_accepted"),
            F.count_if(F.col("disposition") == "dropped").alias("n_dropped"),
            refusal.alias("_refusal"),
            F.sort_array(ids).alias("_ids"),
        )
        .select(
            "request_id",
            "kind",
            F.when(F.col("n_accepted") > 0, "accepted").alias("status"),
            F.when(F.col("n_accepted") == 0, F.coalesce("_refusal", F.lit("ValidationError"))).alias(
                "code"
            ),
            "n_accepted",
            "n_dropped",
            F.transform("_ids", lambda entry: entry.event_id).alias("event_ids"),
        )
    )
