import random

import pytest
from conftest import NOW, seconds
from pyspark.sql import functions as F

from eventloom.model import EVENT_TYPES, FUNNEL_STEPS
from eventloom.operators import analytics
from eventloom.plans.skew import SALT, hot_keys, salted_join

SCHEMA = """event_id string, project_id string, session_id string, event_type string, timestamp timestamp,
 properties struct<product_id:string, price:long, quantity:int, currency:string, category:string>"""


def activity(count=1500, seed=3):
    """Events of which one session holds a third; many share a timestamp."""
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        session = "hot" if n % 3 == 0 else f"s{draw.randrange(200)}"
        product = f"p{draw.randrange(4)}"
        at = NOW + seconds(draw.randrange(400))
        event_type = draw.choice(EVENT_TYPES)
        properties = (product, draw.randrange(1, 999), draw.randrange(1, 4), draw.choice(["USD", "EUR"]), "c")
        rows.append((f"e{draw.randrange(10**9):09d}-{n}", f"p{draw.randrange(2)}", session, event_type, at, properties))
    return rows


def sessions_of(rows):
    sessions = {}
    for row in sorted(rows, key=lambda r: (r[4], r[0])):
        if row[2] is not None:
            sessions.setdefault((row[1], row[2]), []).append(row)
    return sessions


@pytest.fixture(scope="module")
def rows():
    return activity() + [("none", "p0", None, "page_view", NOW, ("p", 1, 1, "USD", "c"))]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_funnel(spark, rows, hot_rows):
    expected = {}
    for (project, _), events in sessions_of(rows).items():
        step = 0
        for event in events:
            if step < 4 and event[3] == FUNNEL_STEPS[step]:
                step += 1
        for reached in range(step):
            expected[(project, reached + 1)] = expected.get((project, reached + 1), 0) + 1
    found = analytics.funnel(spark.createDataFrame(rows, SCHEMA), hot_rows).collect()
    assert {(row.project_id, row.step): row.sessions for row in found} == expected
    first = [row for row in found if row.step == 1]
    assert {row.step_rate for row in first} == {1.0}


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_cart_state(spark, rows, hot_rows):
    expected = {}
    for session, events in sessions_of(rows).items():
        cart = {}
        for event in events:
            change = {"add_to_cart": 1, "remove_from_cart": -1}.get(event[3])
            if event[3] == "purchase":
                cart = {}
            elif change:
                cart[event[5][0]] = cart.get(event[5][0], 0) + change
        expected |= {(*session, product): max(n, 0) for product, n in cart.items()}
    carts = analytics.cart_state(spark.createDataFrame(rows, SCHEMA), hot_rows)
    found = {(r.project_id, r.session_id, r.product_id): r.quantity for r in carts.collect()}
    assert found == expected
    left = analytics.abandoned_carts(carts).collect()
    assert sum(row["items"] for row in left) == sum(expected.values())
    assert len(left) == len({key[:2] for key, n in expected.items() if n})


def test_session_summary(spark, rows):
    found = analytics.session_summary(spark.createDataFrame(rows, SCHEMA)).collect()
    sessions = sessions_of(rows)
    assert len(found) == len(sessions)
    for row in found:
        events = sessions[(row.project_id, row.session_id)]
        assert row.events == len(events)
        assert row.page_views == sum(e[3] == "page_view" for e in events)
        assert row.viewed_products == len({e[5][0] for e in events if e[3] == "product_view"})
        assert row.started_at == events[0][4].replace(tzinfo=None)
        assert row.ended_at == events[-1][4].replace(tzinfo=None)


def test_revenue_and_mix(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    bought = [row for row in rows if row[3] == "purchase"]
    total = analytics.revenue(frame).agg(F.sum("revenue"), F.sum("units"), F.sum("purchases")).first()
    assert tuple(total) == (sum(r[5][1] * r[5][2] for r in bought), sum(r[5][2] for r in bought), len(bought))
    mix = {row.event_type: row for row in analytics.event_mix(frame).collect()}
    assert set(mix) == set(EVENT_TYPES)
    assert mix["purchase"].events == len(bought) and mix["purchase"].target_share == 0.07
    assert sum(row.share for row in mix.values()) == pytest.approx(1)


def test_hot_keys_are_found_and_spread(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k")
    )
    found = spark.range(1).select(F.size(hot_keys(rows, ["k"], hot_rows=1000)).alias("n")).first().n
    assert found == 1
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = salted_join(rows, lookup, ["k"], ["n"], hot_rows=1000)
    assert joined.count() == 30_000 and joined.where("v != k * 2").count() == 0
    per_salt = joined.where("k = 7").groupBy(SALT).count().agg(F.count("*"), F.max("count")).first()
    assert per_salt[0] == 64 and per_salt[1] < 400
