import json

import pytest
from conftest import NOW, SETTINGS, seconds
from pyspark.sql import functions as F
from test_store import wire

from eventloom.operators import metrics
from eventloom.operators.wire import decode_messages, decoded_events
from eventloom.plans import spread
from eventloom.registry import inputs
from eventloom.settings import Settings
from eventloom.sources import raw, store
from eventloom.streaming import consume, health

ONE_FILE = Settings(environment="test", files_per_trigger=1)


def put(spark, path, texts, start=0):
    rows = [(f"m{start + n:04d}", bytearray(text, "utf-8")) for n, text in enumerate(texts)]
    spark.createDataFrame(rows, "msg_id string, data binary").coalesce(1).write.mode("append").parquet(path)


def run(spark, folder, **options):
    stream = raw.stream_messages(spark, folder("log"), ONE_FILE)
    query = consume.consume(stream, folder("events"), folder("letters"), folder("checkpoint"), **options)
    query.awaitTermination()
    return query


def numbers(spark, folder):
    return sorted(int(row.event_id[-4:]) for row in store.read_events(spark, folder("events")).collect())


def test_duplicates_and_poison_over_several_batches(spark, folder):
    for part in range(4):
        texts = [wire(50 * part + n) for n in range(50)] + [wire(n) for n in range(10)] + ["not_json", ""]
        put(spark, folder("log"), texts, 100 * part)
    query = run(spark, folder)
    assert numbers(spark, folder) == list(range(200))
    letters = store.read_dead_letters(spark, folder("letters"))
    assert metrics.dead_letter_size(letters).first()[0] == 8
    assert metrics.processed_total(store.read_events(spark, folder("events"))).first()[0] == 200
    reports = health.health_rows(spark, query.recentProgress)
    assert sorted(row.batch_id for row in reports.collect()) == [0, 1, 2, 3]
    assert reports.agg(F.sum("messages"), F.sum("empty_messages")).first()[:] == (248, 4)
    assert health.backlog(reports).first().batch_id == 3


def test_restart_continues_after_the_last_batch(spark, folder):
    put(spark, folder("log"), [wire(n) for n in range(5)])
    run(spark, folder)
    put(spark, folder("log"), [wire(n) for n in range(3, 9)], 10)
    query = run(spark, folder)
    assert numbers(spark, folder) == list(range(9))
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] != []
    assert {row.batch_id for row in store.read_events(spark, folder("events")).collect()} == {0, 1}


def test_a_failed_batch_is_replayed(spark, folder, monkeypatch):
    put(spark, folder("log"), [wire(n) for n in range(5)] + ["not_json"])
    with monkeypatch.context() as patch:

        def fail(*_):
            raise RuntimeError("lost after the events were written")

        patch.setattr(consume, "append_dead_letters", fail)
        with pytest.raises(Exception, match="lost after"):
            run(spark, folder)
    assert numbers(spark, folder) == list(range(5))
    run(spark, folder)
    assert numbers(spark, folder) == list(range(5))
    assert store.read_dead_letters(spark, folder("letters")).count() == 1


def test_lag_is_what_is_appended_but_not_consumed(spark, folder):
    put(spark, folder("log"), [wire(n) for n in range(5)])
    log = raw.read_messages(spark, folder("log"))
    done = log.where("msg_id < 'm0002'")
    assert metrics.consumer_lag(log, done).first()[0] == 3


def test_watermark_deduplication(spark, folder):
    for part in range(4):
        texts = [wire(n, timestamp=(NOW - seconds(n)).isoformat()) for n in (*range(50 * part, 50 * part + 50), *range(12))]
        put(spark, folder("log"), texts, 100 * part)
    stream = raw.stream_messages(spark, folder("log"), ONE_FILE)
    distinct = consume.without_duplicates(decoded_events(decode_messages(stream)))
    query = (
        distinct.writeStream.format("parquet")
        .option("path", folder("distinct"))
        .option("checkpointLocation", folder("checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(folder("distinct")).count() == 200


def test_request_stream(spark, folder):
    rows = [{"request_id": str(n), "kind": "single", "api_key": "k", "received_at": NOW.isoformat(), "body": "{}"} for n in range(3)]
    path = folder("requests")
    spark.createDataFrame([(json.dumps(row),) for row in rows], "value string").write.text(path)
    assert raw.read_requests(spark, path).where("received_at = timestamp'2024-01-31'").count() == 3
    seen = []
    stream = raw.stream_requests(spark, path, SETTINGS)
    consume.start(stream, lambda batch, n: seen.append(batch.count()), folder("checkpoint")).awaitTermination()
    assert sum(seen) == 3


def test_health_log(spark, folder):
    log = health.HealthLog(spark, folder("health"))
    put(spark, folder("log"), [wire(1)])
    query = run(spark, folder)

    class Event:
        progress = query.recentProgress[0]

    log.onQueryProgress(Event)
    assert spark.read.parquet(folder("health")).first().messages == 1


def test_a_part_is_one_micro_batch_of_several_files(spark, folder, monkeypatch):
    """Whatever the size of the parts; the third has no rows, the last fewer than there are files."""
    monkeypatch.setattr(inputs, "PART_FILE_ROWS", 40)
    days = ["2024-01-01"] * 200 + ["2024-01-09"] * 130 + ["2024-01-30"] * 2 + [None]
    rows = [(n, day, n % 7, "view", 1.0, '{"k": 1}') for n, day in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(folder("sf/events.parquet"))
    seen = {}
    stream = inputs.stream_events(spark, folder("sf"))
    handle = lambda batch, n: seen.update({n: sorted(row.event_id for row in batch.collect())})
    consume.start(stream, handle, folder("checkpoint")).awaitTermination()
    assert seen == {0: [*range(200), 332], 1: [*range(200, 330)], 2: [], 3: [330, 331]}


def test_large_inputs_are_dealt_to_tasks_of_a_bounded_size(spark, folder):
    spark.range(5).coalesce(1).write.parquet(folder("ids"))
    scan, rows = spark.read.parquet(folder("ids")), 40 * spread.ROWS_PER_TASK
    assert spread.spread(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread.spread(scan, rows - 1).rdd.getNumPartitions() == 40
    assert inputs.spread_stream(scan, rows).rdd.getNumPartitions() == 40
