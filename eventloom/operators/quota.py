"""Request quotas per identity and time window.

Counting first keeps this cheap at any size: windows at or under their limit
need no order at all, so only the requests of exceeded windows are ranked, and
those in two steps so that a single huge window is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import strip
from eventloom.operators.anchors import opened
from eventloom.operators.tenants import key_problem
from eventloom.settings import Settings

RANKED_PER_TASK = 1_000_000


def address_identity(forwarded_for: Column, client_ip: Column) -> Column:
    """`ip:` plus the first forwarded hop, else the peer, else `unknown`."""
    first_hop = F.when(forwarded_for != "", strip(F.split(forwarded_for, ",")[0]))
    return F.concat(F.lit("ip:"), F.coalesce(first_hop, client_ip, F.lit("unknown")))


def creation_identity(client_ip: Column) -> Column:
    """Identity that project creation is metered under; forwarding is not trusted."""
    return F.concat(F.lit("project_create:"), F.coalesce(client_ip, F.lit("unknown")))


def creation_quota(creations: DataFrame, settings: Settings) -> DataFrame:
    """Meter project creations per peer address; adds `identity`, `quota`, `window_start`, `admitted`.

    Senders with a key of the right form are not metered.
    """
    anonymous = key_problem(F.col("api_key"), settings).isNotNull()
    identified = creations.withColumns(
        {
            "identity": F.when(anonymous, creation_identity(F.col("client_ip"))),
            "quota": F.lit(settings.quota_project_create),
        }
    )
    return fixed_window_quota(identified, settings)


def plan_limit(plan: Column, settings: Settings) -> Column:
    limits = F.create_map(
        F.lit("free"),
        F.lit(settings.quota_free),
        F.lit("pro"),
        F.lit(settings.quota_pro),
        F.lit("enterprise"),
        F.lit(settings.quota_enterprise),
    )
    return F.coalesce(limits[plan], F.lit(settings.quota_anonymous))


def with_quota_identity(requests: DataFrame, settings: Settings) -> DataFrame:
    """Add `identity` and `quota` to requests whose tenant is resolved.

    A well-formed but unknown key has no identity: it is refused, not metered.
    """
    anonymous = key_problem(F.col("api_key"), settings).isNotNull()
    project = F.concat(F.lit("project:"), F.col("project_id"))
    return requests.withColumns(
        {
            "identity": F.when(
                anonymous, address_identity(F.col("forwarded_for"), F.col("client_ip"))
            ).otherwise(project),
            "quota": F.when(anonymous, F.lit(settings.quota_anonymous)).when(
                F.col("project_id").isNotNull(), plan_limit(F.col("plan"), settings)
            ),
        }
    )


def clock_window(at: Column, seconds: int) -> Column:
    """Start of the clock-aligned window `at` falls in."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(at) / seconds) * seconds)


def admit(
    requests: DataFrame,
    group: list[str],
    order: list[str],
    limit: str = "quota",
    ranked_per_task: int = RANKED_PER_TASK,
) -> DataFrame:
    """Add `admitted`: whether a row is among its group's first `limit` rows.

    `limit` is a column that is constant within a group.  Rows whose first
    `group` column is null are admitted; they are not metered.
    """
    metered = requests.where(F.col(group[0]).isNotNull())
    exceeded = (
        metered.groupBy(*group)
        .agg(F.count("*").alias("_rows"), F.max(limit).alias("_limit"))
        .where(F.col("_rows") > F.col("_limit"))
    )

    # The first `limit` of a group are among the first `limit` of each of its
    # shares; a share is small enough for one task whatever the group's size.
    key = F.struct(*order)
    shares = F.ceil(F.col("_rows") / ranked_per_task)
    share = F.pmod(F.xxhash64(*order), shares)
    by_share = Window.partitionBy(*group, "_share").orderBy(*order)
    by_group = Window.partitionBy(*group).orderBy(*order)
    last_admitted = (
        metered.select(*dict.fromkeys([*group, *order]))
        .join(exceeded, group)
        .withColumn("_share", share)
        .withColumn("_rank", F.row_number().over(by_share))
        .where(F.col("_rank") <= F.col("_limit"))
        .withColumn("_rank", F.row_number().over(by_group))
        .where(F.col("_rank") == F.col("_limit"))
        .select(*group, key.alias("_last"))
    )
    cutoffs = exceeded.select(*group, F.lit(True).alias("_exceeded")).join(last_admitted, group, "left")
    decided = F.col("_exceeded").isNull() | F.coalesce(key <= F.col("_last"), F.lit(False))
    return (
        requests.join(cutoffs, group, "left")
        .withColumn("admitted", decided)
        .drop("_exceeded", "_last")
    )


def fixed_window_quota(requests: DataFrame, settings: Settings) -> DataFrame:
    """Meter by clock-aligned windows; adds `window_start` and `admitted`."""
    windowed = requests.withColumn(
        "window_start", clock_window(F.col("received_at"), settings.quota_window_seconds)
    )
    return admit(windowed, ["identity", "window_start"], ["received_at", "request_id"])


def anchored_window_quota(requests: DataFrame, settings: Settings) -> DataFrame:
    """Meter by windows that open at an identity's first request after the last one closed."""
    windowed = anchor_windows(requests, settings.quota_window_seconds)
    return admit(windowed, ["identity", "window_start"], ["received_at", "request_id"])


def anchor_windows(
    requests: DataFrame, seconds: int, open_windows: DataFrame | None = None, **split: int
) -> DataFrame:
    """Add `window_start` for anchored windows, at millisecond resolution.

    What is walked in order is the distinct milliseconds of an identity, those of a
    busy one by many tasks (`operators.anchors`, which `split` is handed on to).
    `open_windows` (identity, opened) carries openings over from earlier data.
    """
    timed = requests.withColumn("_millis", F.unix_millis("received_at"))
    times = timed.where(F.col("identity").isNotNull()).select("identity", F.col("_millis").alias("millis")).distinct()
    starts = opened(times, seconds * 1000, open_windows, **split)
    return (
        timed.join(starts.withColumnRenamed("millis", "_millis"), ["identity", "_millis"], "left")
        .withColumn("window_start", F.timestamp_millis("opened"))
        .drop("_millis", "opened")
    )
