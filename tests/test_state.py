"""Keyed state with timers, what a file source has not read yet, gauges, and strict reading of stored rows."""

from dataclasses import replace

import pytest
from conftest import NOW, SETTINGS, seconds
from pyspark.sql import functions as F
from test_quota import SCHEMA, by_fixed_windows, traffic
from test_store import event, wire
from test_streams import put, run

from eventloom.operators import metrics
from eventloom.sources import store
from eventloom.streaming import health
from eventloom.streaming.meter import metered_stream
from eventloom.streaming.state import state_on_disk

LIMITS = replace(SETTINGS, quota_window_seconds=60)


def decide(spark, folder, parts, keep):
    """Each part as one micro-batch; returns the decisions, and the identities that state is left for."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder("requests"))
        stream = spark.readStream.schema(SCHEMA).parquet(folder("requests"))
        with state_on_disk(spark):
            query = (
                metered_stream(stream, LIMITS, keep)
                .writeStream.format("parquet")
                .option("path", folder("decisions"))
                .option("checkpointLocation", folder("checkpoint"))
                .trigger(availableNow=True)
                .start()
            )
        query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "used").load(folder("checkpoint"))
    return spark.read.parquet(folder("decisions")), {row.key.identity for row in state.select("key").collect()}


def test_decisions_by_state_are_those_of_a_plain_count(spark, folder):
    rows = sorted(traffic(600, 200, 3), key=lambda r: (r[2], r[0])) + [("free", None, NOW, None)]
    judged, _ = decide(spark, folder, [rows[:250], rows[250:]], 3_600)
    assert {r.request_id: r.admitted for r in judged.collect()} == by_fixed_windows(rows[:-1]) | {"free": True}
    refused = judged.where("NOT admitted").count()
    assert refused > 0 and judged.count() == 601


def test_a_window_is_forgotten_when_it_has_passed(spark, folder):
    old = [("a", "x", NOW, 1), ("b", "x", NOW + seconds(1), 1)]
    late = [("c", "y", NOW + seconds(10_000), 1)]
    judged, held = decide(spark, folder, [old, late, [("d", "z", NOW + seconds(10_060), 1)]], 120)
    assert {r.request_id for r in judged.where("admitted").collect()} == {"a", "c", "d"}
    assert "x" not in held and "z" in held


def test_what_a_file_source_has_not_read_yet(spark, folder):
    put(spark, folder("log"), [wire(n) for n in range(5)])
    rows = spark.read.schema("msg_id string, data binary").parquet(folder("log"))
    assert health.unread(rows, folder("checkpoint")).first().lag == 5
    run(spark, folder)
    put(spark, folder("log"), [wire(n) for n in range(5, 12)] + ["not_json"], 10)
    rows = spark.read.schema("msg_id string, data binary").parquet(folder("log"))
    assert health.unread(rows, folder("checkpoint")).first().lag == 8
    run(spark, folder)
    assert health.unread(rows, folder("checkpoint")).first().lag == 0


def test_gauges_are_taken_from_time_to_time(spark, folder):
    put(spark, folder("log"), [wire(1), "not_json"])
    progress = run(spark, folder).recentProgress[0]
    letters = store.read_dead_letters(spark, folder("letters"))

    def take():
        return 7, metrics.dead_letter_size(letters).first()[0]

    class Event:
        pass

    Event.progress = progress
    seldom = health.HealthLog(spark, folder("health"), gauges=(folder("gauges"), take), every=3_600)
    for _ in range(3):
        seldom.onQueryProgress(Event)
        seldom.onQueryIdle(Event)
    assert [(r.lag, r.dlq_size) for r in spark.read.parquet(folder("gauges")).collect()] == [(7, 1)]
    assert health.reported(spark, folder("health")).count() == 1  # a replayed batch reports again
    often = health.HealthLog(spark, folder("health"), gauges=(folder("gauges"), take), every=0)
    often.onQueryIdle(Event)
    assert spark.read.parquet(folder("gauges")).count() == 2
    assert health.late_drops(health.reported(spark, folder("health"))).first().late_rows == 0


@pytest.mark.parametrize(
    "text, problem",
    [
        (None, None),
        ('{"price": 5, "quantity": 2, "page_url": "x"}', None),
        ('{"price": null, "other": [1]}', None),
        ('{"price": "abc"}', "unreadable price"),
        ('{"price": 1.5}', "unreadable price"),
        ('{"quantity": 99999999999}', "unreadable quantity"),
        ("[1]", "properties are no object"),
        ("{", "properties are no object"),
    ],
)
def test_stored_rows_are_read_strictly(spark, text, problem):
    row = (*event(1)[:6], text, NOW)
    names = "event_id string, project_id string, user_id string, session_id string, event_type string"
    rows = spark.createDataFrame([row], f"{names}, timestamp timestamp, properties string, created_at timestamp")
    assert [x.problem for x in store.stored_problems(rows).collect()] == ([] if problem is None else [problem])
    if problem:
        with pytest.raises(Exception, match=problem):
            store.decode_stored(rows).collect()
    else:
        assert store.decode_stored(rows).select(F.col("properties.price")).count() == 1
