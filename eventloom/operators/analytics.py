"""Questions over stored events: funnel, sessions, carts, revenue and mix.

A session is a session id within a project; events without one belong to none.
Nothing here sorts a session or holds one in a task: order within a session is
expressed by comparing with aggregated bounds, and ties in time break on the
event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.model import FUNNEL_STEPS, TARGET_MIX
from eventloom.plans.skew import HOT_ROWS, SALT, salted_join

SESSION = ["project_id", "session_id"]


def in_sessions(events: DataFrame) -> DataFrame:
    return events.where(F.col("session_id").isNotNull())


def _when_type(event_type: str, value: Column) -> Column:
    return F.when(F.col("event_type") == event_type, value)


def funnel(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions per project that reach each of the four steps in order.

    With the steps 1-4, a session reaches step 2 when a 2 follows its first 1,
    step 3 when the earliest such 2 is followed by a 3, and step 4 when that 2
    precedes the last 3 that a 4 follows.  So the first 1 and the last 3 and 4
    per session, and one look back at its 2s and 3s, decide all steps.
    """
    one, two, three, four = FUNNEL_STEPS
    at = F.struct("timestamp", "event_id")
    steps = in_sessions(events).where(F.col("event_type").isin(FUNNEL_STEPS)).select(
        *SESSION, "event_type", at.alias("at")
    )
    bounds = steps.groupBy(*SESSION).agg(
        F.min(_when_type(one, F.col("at"))).alias("first_1"),
        F.max(_when_type(three, F.col("at"))).alias("last_3"),
        F.max(_when_type(four, F.col("at"))).alias("last_4"),
    )
    # Sessions without a first step count nowhere, and need no second look.
    started = bounds.where(F.col("first_1").isNotNull())
    middle = steps.where(F.col("event_type").isin(two, three))
    partial = (
        salted_join(middle, started, SESSION, ["at"], hot_rows=hot_rows)
        .groupBy(*SESSION, SALT)
        .agg(
            F.min(_when_type(two, F.when(F.col("at") > F.col("first_1"), F.col("at")))).alias("two_at"),
            F.max(_when_type(three, F.when(F.col("at") < F.col("last_4"), F.col("at")))).alias("three_at"),
            F.any_value("last_3").alias("last_3"),
        )
    )
    reached = partial.groupBy(*SESSION).agg(
        F.min("two_at").alias("two_at"),
        F.max("three_at").alias("three_at"),
        F.any_value("last_3").alias("last_3"),
    )
    deeper = reached.groupBy("project_id").agg(
        F.count_if(F.col("two_at").isNotNull()).alias("_2"),
        F.count_if(F.col("two_at") < F.col("last_3")).alias("_3"),
        F.count_if(F.col("two_at") < F.col("three_at")).alias("_4"),
    )
    entered = started.groupBy("project_id").agg(F.count("*").alias("_1"))
    per_project = entered.join(deeper, "project_id", "left")

    counts = [F.coalesce(f"_{n}", F.lit(0)) for n in (1, 2, 3, 4)]
    rows = F.array(
        *[
            F.struct(
                F.lit(n + 1).alias("step"),
                F.lit(name).alias("event_type"),
                counts[n].alias("sessions"),
                F.try_divide(counts[n], counts[max(n - 1, 0)]).alias("step_rate"),
            )
            for n, name in enumerate(FUNNEL_STEPS)
        ]
    )
    return per_project.select("project_id", F.inline(rows))


def session_summary(events: DataFrame) -> DataFrame:
    """Page views, distinct viewed products, bounds and size of each session."""
    product = F.col("properties.product_id")
    return in_sessions(events).groupBy(*SESSION).agg(
        F.count_if(F.col("event_type") == "page_view").alias("page_views"),
        F.count_distinct(_when_type("product_view", product)).alias("viewed_products"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count("*").alias("events"),
    )


def cart_state(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Products left in the cart at the end of each session.

    Adds minus removes since the session's last purchase, per product, never
    below zero; sessions with something left are abandoned carts.
    """
    at = F.struct("timestamp", "event_id")
    actions = in_sessions(events).where(
        F.col("event_type").isin("add_to_cart", "remove_from_cart", "purchase")
    ).select(*SESSION, "event_type", F.col("properties.product_id").alias("product_id"), at.alias("at"))
    last_purchase = (
        actions.where(F.col("event_type") == "purchase").groupBy(*SESSION).agg(F.max("at").alias("bought_at"))
    )
    moves = actions.where(F.col("event_type") != "purchase")
    change = F.when(F.col("event_type") == "add_to_cart", 1).otherwise(-1)
    return (
        salted_join(moves, last_purchase, SESSION, ["at"], "left", hot_rows)
        .where(F.col("bought_at").isNull() | (F.col("at") > F.col("bought_at")))
        .groupBy(*SESSION, "product_id")
        .agg(F.greatest(F.sum(change), F.lit(0)).alias("quantity"))
    )


def abandoned_carts(carts: DataFrame) -> DataFrame:
    """Sessions that end with products in the cart."""
    return (
        carts.where(F.col("quantity") > 0)
        .groupBy(*SESSION)
        .agg(F.count("*").alias("products"), F.sum("quantity").alias("items"))
    )


def revenue(events: DataFrame) -> DataFrame:
    """Purchases in minor units by project, currency and category."""
    properties = F.col("properties")
    return (
        events.where(F.col("event_type") == "purchase")
        .groupBy("project_id", properties.currency.alias("currency"), properties.category.alias("category"))
        .agg(
            F.count("*").alias("purchases"),
            F.sum(properties.quantity).alias("units"),
            # The log does not bound prices; an overflow must not fail the job.
            F.try_sum(F.try_multiply(properties.price, properties.quantity)).alias("revenue"),
        )
    )


def event_mix(events: DataFrame) -> DataFrame:
    """Share of each event type against its target, in one pass."""
    names = list(TARGET_MIX)
    totals = events.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("event_type") == name).alias(name) for name in names],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("event_type"),
                F.col(name).alias("events"),
                F.try_divide(F.col(name), F.col("total")).alias("share"),
                F.lit(target / 100).alias("target_share"),
            )
            for name, target in TARGET_MIX.items()
        ]
    )
    return totals.select(F.inline(rows))
