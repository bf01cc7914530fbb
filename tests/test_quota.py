import random
from dataclasses import replace
from datetime import timezone

import pytest
from conftest import NOW, SETTINGS, seconds
from pyspark.sql import functions as F

from eventloom.operators.quota import admit, anchor_windows, anchored_window_quota, fixed_window_quota
from eventloom.streaming.quota import quota_batch

SCHEMA = "request_id string, identity string, received_at timestamp, quota int"
LIMITS = replace(SETTINGS, quota_window_seconds=60)


def traffic(count, span, identities, seed=1):
    """Requests of which the first identity sends more than half."""
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        who = 0 if draw.random() < 0.6 else draw.randrange(identities)
        at = NOW + seconds(round(draw.uniform(0, span), 3))
        rows.append((f"r{n:05d}", f"i{who}", at, 5 + who))
    return rows


def by_fixed_windows(rows):
    used, admitted = {}, {}
    for request_id, identity, at, limit in sorted(rows, key=lambda r: (r[2], r[0])):
        slot = (identity, int(at.timestamp()) // 60)
        used[slot] = used.get(slot, 0) + 1
        admitted[request_id] = used[slot] <= limit
    return admitted


def by_anchored_windows(rows):
    opened, used, admitted, starts = {}, {}, {}, {}
    for request_id, identity, at, limit in sorted(rows, key=lambda r: (r[2], r[0])):
        if identity not in opened or at >= opened[identity] + seconds(60):
            opened[identity], used[identity] = at, 0
        used[identity] += 1
        admitted[request_id] = used[identity] <= limit
        starts[request_id] = opened[identity].replace(tzinfo=None)
    return admitted, starts


def found(judged):
    return {row.request_id: row.admitted for row in judged.select("request_id", "admitted").collect()}


def test_fixed_windows_match_a_plain_count(spark):
    rows = traffic(3000, 600, 6)
    judged = fixed_window_quota(spark.createDataFrame(rows, SCHEMA), LIMITS)
    assert found(judged) == by_fixed_windows(rows)


def test_a_window_spread_over_many_tasks_gives_the_same(spark):
    rows = traffic(3000, 600, 3)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("w", F.date_trunc("minute", "received_at"))
    judged = admit(frame, ["identity", "w"], ["received_at", "request_id"], ranked_per_task=7)
    assert found(judged) == by_fixed_windows(rows)


def test_requests_at_the_same_instant(spark):
    rows = [(f"r{n}", "i", NOW, 3) for n in range(9)]
    judged = fixed_window_quota(spark.createDataFrame(rows, SCHEMA), LIMITS)
    assert {r for r, ok in found(judged).items() if ok} == {"r0", "r1", "r2"}


def test_limit_zero_and_unmetered_rows(spark):
    rows = [("a", "i", NOW, 0), ("b", None, NOW, None), ("c", "j", NOW, 1)]
    judged = fixed_window_quota(spark.createDataFrame(rows, SCHEMA), LIMITS)
    assert found(judged) == {"a": False, "b": True, "c": True}


def test_window_reopens_exactly_at_its_end(spark):
    rows = [("a", "i", NOW, 1), ("b", "i", NOW + seconds(59.999), 1), ("c", "i", NOW + seconds(60), 1)]
    judged = anchored_window_quota(spark.createDataFrame(rows, SCHEMA), LIMITS)
    assert found(judged) == {"a": True, "b": False, "c": True}


def test_anchored_windows_match_a_plain_loop(spark):
    for seed, span in [(1, 900), (2, 9000), (3, 100_000)]:
        rows = traffic(2000, span, 5, seed)
        admitted, starts = by_anchored_windows(rows)
        judged = anchored_window_quota(spark.createDataFrame(rows, SCHEMA), LIMITS)
        assert found(judged) == admitted
        windowed = anchor_windows(spark.createDataFrame(rows, SCHEMA), 60)
        assert {r.request_id: r.window_start for r in windowed.collect()} == starts


@pytest.mark.parametrize(("length", "span"), [(1_000, 300), (20_000, 2_000), (60_000, 2_000), (250_000, 9_000)])
def test_a_busy_identity_is_walked_in_segments(spark, length, span):
    """Segments shorter than, as long as and longer than a window, with and without a window open before."""
    rows = traffic(1200, span, 4, length)
    _, starts = by_anchored_windows(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    windowed = anchor_windows(frame, 60, most=50, length=length)
    assert {r.request_id: r.window_start for r in windowed.collect()} == starts
    half = NOW + seconds(span / 2)
    opened = {}
    for request_id, identity, at, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if at < half:
            opened[identity] = starts[request_id]
    carried = [(k, int(v.replace(tzinfo=timezone.utc).timestamp() * 1000)) for k, v in opened.items()]
    later = frame.where(F.col("received_at") >= F.lit(half))
    windowed = anchor_windows(later, 60, spark.createDataFrame(carried, "identity string, opened long"), most=50, length=length)
    assert {r.request_id: r.window_start for r in windowed.collect()} == {r[0]: starts[r[0]] for r in rows if r[2] >= half}


def test_no_task_walks_a_busy_identity_alone(spark):
    rows = [(f"r{n}", "busy" if n % 5 else f"i{n % 3}", NOW + seconds(n), 5) for n in range(2_000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    windowed = anchor_windows(frame, 60, most=100, length=100_000).where("identity = 'busy'")
    plan = windowed._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line.split("RepartitionByExpression")[1] for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert dealt and all("segment" in line for line in dealt)
    assert windowed.select("window_start").distinct().count() == 2_000 // 60 + 1


def test_micro_batches_carry_their_use_over(spark, folder):
    rows = sorted(traffic(1500, 400, 3), key=lambda r: (r[2], r[0]))
    for anchored, expected in [(False, by_fixed_windows(rows)), (True, by_anchored_windows(rows)[0])]:
        decisions, ledger = folder(f"decisions-{anchored}"), folder(f"ledger-{anchored}")
        for batch_id in range(5):
            part = spark.createDataFrame(rows[300 * batch_id : 300 * (batch_id + 1)], SCHEMA)
            for _ in range(2):  # a replay changes nothing
                quota_batch(part, batch_id, decisions, ledger, LIMITS, anchored)
        assert found(spark.read.parquet(decisions)) == expected


def test_empty_micro_batches_are_judged(spark, folder):
    """A part of a log without rows, as the first micro-batch, between others and as the last."""
    rows = sorted(traffic(600, 400, 3), key=lambda r: (r[2], r[0]))
    for anchored, expected in [(False, by_fixed_windows(rows)), (True, by_anchored_windows(rows)[0])]:
        decisions, ledger = folder(f"decisions-{anchored}"), folder(f"ledger-{anchored}")
        for batch_id, part in enumerate([[], rows[:300], [], rows[300:], []]):
            quota_batch(spark.createDataFrame(part, SCHEMA), batch_id, decisions, ledger, LIMITS, anchored)
        assert found(spark.read.parquet(decisions)) == expected
