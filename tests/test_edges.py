"""Rows that no given table holds: over-long lists, moved copies, odd times, mistyped values, repeated ids."""

from dataclasses import replace
from datetime import timedelta

import pytest
from conftest import KNOWN, NOW, SETTINGS, raw_event, request, requests_of
from pyspark.sql import functions as F
from test_store import event, events_of, messages_of, wire
from test_streams import ONE_FILE, put

from eventloom.functions.ids import event_key
from eventloom.model import EVENT, PROJECT
from eventloom.operators import metrics
from eventloom.operators.projects import judge_projects
from eventloom.operators.quota import creation_quota
from eventloom.operators.rejects import reject_records
from eventloom.operators.wire import dead_letters, decode_messages, decoded_events, encode_events
from eventloom.plans.ingest import accepted_events, outcomes, receipts
from eventloom.sources import dimension, raw, store
from eventloom.streaming import consume, health


@pytest.fixture(scope="module")
def long_lists(spark):
    few = replace(SETTINGS, max_batch=5)
    rows = [
        request("junk", {"events": [1] * 60}, "batch"),
        request("one good", {"events": [raw_event(), *[{}] * 60]}, "batch"),
        request("full and junk", {"events": [*[raw_event()] * 5, *[1] * 60]}, "batch"),
        request("too many", {"events": [*[raw_event()] * 6, 1, 2]}, "batch"),
        request("no body", None, "batch"),
    ]
    projects = spark.createDataFrame(
        [(KNOWN, "one", "free", "wk_test_1", NOW)],
        "project_id string, name string, plan string, api_key string, created_at timestamp",
    )
    return outcomes(requests_of(spark, rows), projects, few).persist()


def test_no_item_of_a_long_list_is_lost(long_lists):
    counts = {row.request_id: row.n for row in long_lists.groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"junk": 60, "one good": 61, "full and junk": 65, "too many": 8, "no body": 1}
    accepted = {row.request_id: row.n for row in long_lists.where("disposition = 'accepted'").groupBy("request_id").agg(F.count("*").alias("n")).collect()}
    assert accepted == {"one good": 1, "full and junk": 5}
    assert accepted_events(long_lists).count() + reject_records(long_lists).count() == 195


def test_every_long_list_has_a_receipt(long_lists):
    found = {row.request_id: (row.status, row.code, row.n_accepted) for row in receipts(long_lists).collect()}
    assert found["one good"] == ("accepted", None, 1)
    assert found["full and junk"] == ("accepted", None, 5)
    assert found["junk"] == (None, "ValidationError", 0)
    assert found["too many"] == (None, "ValidationError", 0)
    assert len(found) == 5


def test_ids_sort_in_batch_order_at_any_position(spark):
    rows = spark.range(0, 9000).withColumn("key", event_key(F.lit(NOW), F.lit("r"), F.col("id")))
    keys = [row.key for row in rows.orderBy("id").collect()]
    assert keys == sorted(keys) and len(set(keys)) == 9000
    assert all(len(key) == 36 and key[14] == "7" and key[19] in "89ab" for key in keys)


def test_planning_with_quotas_runs_no_job(spark, projects):
    metered = replace(SETTINGS, quota_enabled=True)
    requests = requests_of(spark, [request("r", raw_event())])
    spark.sparkContext.setJobGroup("planning", "planning")
    outcomes(requests, projects, metered)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("", "")


def test_an_id_is_stored_once_whatever_its_day(spark, folder):
    path = folder("store")
    store.append_events(events_of(spark, [event(1)]), path, 0)
    store.append_events(events_of(spark, [event(1, at=NOW - timedelta(days=5)), event(2)]), path, 1)
    assert sorted(row.event_id[-1] for row in store.read_events(spark, path).collect()) == ["1", "2"]


def test_a_replay_with_fewer_rows_leaves_no_old_ones(spark, folder):
    path, letters = folder("store"), folder("letters")
    store.append_events(events_of(spark, [event(1, at=NOW - timedelta(days=9)), event(2)]), path, 0)
    store.append_events(events_of(spark, [event(2)]), path, 0)
    assert [row.event_id[-1] for row in store.read_events(spark, path).collect()] == ["2"]
    bad = dead_letters(decode_messages(messages_of(spark, ["not_json"])))
    store.append_dead_letters(bad, letters, 0)
    store.append_dead_letters(bad.limit(0), letters, 0)
    assert store.read_dead_letters(spark, letters).count() == 0


def test_a_lookup_by_id_reads_only_the_days_it_may_lie_on(spark, folder):
    path = folder("store")
    rows = [event(n, at=NOW - timedelta(days=n)) for n in range(0, 30, 5)]
    store.append_events(events_of(spark, rows), path, 0)
    found = store.event_by_id(store.read_events(spark, path), rows[3][0], SETTINGS)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_pages_by_cursor(spark, folder):
    path = folder("store")
    rows = [event(n, at=NOW - timedelta(hours=n // 3)) for n in range(20)]
    store.append_events(events_of(spark, rows), path, 0)
    stored, seen, after = store.read_events(spark, path), [], None
    while page := store.page_after(stored, KNOWN, after, limit=7).collect():
        seen += [row.event_id for row in page]
        after = (page[-1].timestamp, page[-1].event_id)
    assert seen == [row[0] for row in sorted(rows, key=lambda row: (row[5], row[0]))]


def test_a_far_future_event_makes_no_others_late(spark, folder):
    for part in range(4):
        texts = [wire(100 * part + n) for n in range(10)]
        if part == 1:
            texts.append(wire(999, timestamp="2099-01-01T00:00:00+00:00"))
        put(spark, folder("log"), texts, 100 * part)
    stream = raw.stream_messages(spark, folder("log"), ONE_FILE)
    distinct = consume.without_duplicates(decoded_events(decode_messages(stream)))
    writer = distinct.writeStream.format("parquet").option("checkpointLocation", folder("checkpoint"))
    writer.option("path", folder("distinct")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(folder("distinct")).count() == 41


@pytest.mark.parametrize(
    ("properties", "name"),
    [
        ({"quantity": 3.5}, "quantity"),
        ({"quantity": 3_000_000_000}, "quantity"),
        ({"price": "1250"}, "price"),
        ({"price": True}, "price"),
        ({"product_id": 7}, "product_id"),
        ({"browser": ["x"]}, "browser"),
    ],
)
def test_mistyped_properties_are_dead_letters(spark, properties, name):
    row = decode_messages(messages_of(spark, [wire(properties=properties)])).first()
    assert row.event is None and row.error_type == "deserialization"
    assert row.error == f"DeserializationError: properties.{name} has the wrong type"


def test_whole_numbers_with_a_fraction_of_zero_are_read(spark):
    texts = [wire(properties={"price": 12.0, "quantity": 3, "category": None, "unknown": [1], "browser": "b"})]
    found = decode_messages(messages_of(spark, texts)).first()
    assert found.error is None and found.error_type is None
    assert (found.event.properties.price, found.event.properties.quantity) == (12, 3)
    assert (found.event.properties.category, found.event.properties.browser) == (None, "b")


def test_every_kind_of_dead_letter_has_its_label(spark, folder, projects):
    gone = "00000000-0000-7000-8000-0000000000ff"
    log = messages_of(spark, ["not_json", "", wire(1, project_id=gone), wire(2)])
    consume.store_batch(log, 0, folder("events"), folder("letters"), projects)
    letters = store.read_dead_letters(spark, folder("letters"))
    counts = {row.error_type: row.errors for row in metrics.errors_by_type(letters).collect()}
    assert counts == {"deserialization": 1, "empty_message_data": 1, "orphan_event": 1}
    assert store.read_events(spark, folder("events")).count() == 1


def test_repeated_project_ids_are_refused(spark):
    rows = [("p1", "alpha", NOW), ("p1", "alpha", NOW), ("p1", "beta", NOW), ("p2", "gamma", NOW), ("p3", "ab", NOW)]
    frame = spark.createDataFrame(rows, "project_id string, name string, created_at timestamp")
    frame = frame.withColumns({"plan": F.lit("free"), "api_key": F.concat(F.lit("k"), "name")})
    found = judge_projects(frame, frame.limit(0).select("project_id", "name"))
    codes = sorted((row.project_id, row.name, row.code or "") for row in found.collect())
    assert codes == [
        ("p1", "alpha", ""),
        ("p1", "alpha", "UnexpectedError"),
        ("p1", "beta", "UnexpectedError"),
        ("p2", "gamma", ""),
        ("p3", "ab", "ValidationError"),
    ]


def test_projects_are_stored_once(spark, folder):
    rows = [("p1", "alpha", "free", "k1", NOW), ("p2", "beta", "pro", "k2", NOW), ("p3", "ab", "pro", "k3", NOW)]
    frame = spark.createDataFrame(rows, PROJECT)
    for batch_id in (0, 0, 1):
        judged = dimension.load_projects(frame, folder("projects"), batch_id)
    codes = {row.project_id: row.code for row in judged.collect()}
    assert codes == {"p1": "UnexpectedError", "p2": "UnexpectedError", "p3": "ValidationError"}
    assert sorted(row.project_id for row in dimension.read_projects(spark, folder("projects")).collect()) == ["p1", "p2"]


def test_removed_projects_lose_their_events(spark, folder, monkeypatch):
    path, other = folder("store"), KNOWN[:-1] + "2"
    store.append_events(events_of(spark, [event(1), event(2, project=other)]), path, 0)
    store.append_events(events_of(spark, [event(3, project=other)]), path, 1)
    store.append_events(events_of(spark, [event(4)]), path, 2)
    removed = spark.createDataFrame([(other,)], "project_id string")
    with monkeypatch.context() as patch:

        def fail(*_):
            raise RuntimeError("lost after staging")

        patch.setattr(dimension, "evenly", fail)
        with pytest.raises(RuntimeError):
            dimension.remove_projects(removed, path, folder("staging"))
    dimension.remove_projects(removed, path, folder("staging"))
    found = {(row.event_id[-1], row.batch_id) for row in store.read_events(spark, path).collect()}
    assert found == {("1", 0), ("4", 2)}


def test_projects_are_removed_from_parts_in_one_job(spark, folder):
    path, other = folder("store"), KNOWN[:-1] + "2"
    day = timedelta(days=1)
    for batch_id in range(6):
        rows = [event(10 * batch_id + k, project=other if k == batch_id else KNOWN, at=NOW - k * day) for k in range(4)]
        rows.append(event(10 * batch_id + 9, project=KNOWN, at=NOW))
        store.append_events(events_of(spark, rows), path, batch_id)
    files = {x.split("file:")[-1] for x in store.read_events(spark, path).inputFiles()}
    removed = spark.createDataFrame([(other,), (other,), ("none",)], "project_id string")
    dimension.remove_projects(removed, path, folder("staging"))
    left = store.read_events(spark, path)
    assert left.count() == 26 and left.where(F.col("project_id") == other).count() == 0
    after = {x.split("file:")[-1] for x in left.inputFiles()}
    assert len(files - after) == 4  # days 0 to 3 of batches 0 to 3; the others' files are the same
    assert all(f"batch_id={x.split('batch_id=')[1][0]}/" in x for x in files - after)
    assert len(after - files) == 1  # only the day that another event shares was written anew


def test_a_stream_is_published(spark, folder):
    events_of(spark, [event(n, event_type="purchase") for n in range(3)]).write.parquet(folder("events"))
    stream = spark.readStream.schema(EVENT).parquet(folder("events"))
    raw.publish(encode_events(stream), folder("log"), folder("checkpoint")).awaitTermination()
    found = decoded_events(decode_messages(raw.read_messages(spark, folder("log"))))
    assert sorted(row.event_id[-1] for row in found.collect()) == ["0", "1", "2"]


def test_creations_are_metered_by_peer(spark):
    rows = [request(str(n), {}, api_key=None, ip="1.1.1.1" if n < 7 else None, forwarded=str(n)) for n in range(9)]
    rows.append(request("keyed", {}, api_key="wk_test_anything", ip="1.1.1.1"))
    judged = creation_quota(requests_of(spark, rows), SETTINGS)
    refused = {row.request_id for row in judged.where("NOT admitted").collect()}
    assert refused == {"5", "6"}
    identities = {row.identity for row in judged.collect()}
    assert identities == {"project_create:1.1.1.1", "project_create:unknown", None}


def test_batch_durations_and_failures(spark):
    reports = spark.createDataFrame(
        [("q", 0, "t", 5, 5, 0, 0.04, None), ("q", 1, "t", 5, 5, 0, 0.7, None), ("q", 2, "t", 5, 5, 0, 20.0, None)],
        health.HEALTH,
    )
    found = {row.le: row.n for row in metrics.batch_durations(reports).collect()}
    assert (found["0.05"], found["1.0"], found["10.0"], found["+Inf"]) == (1, 2, 2, 3)
    failures = spark.createDataFrame([("q", "2024-01-01", "lost")], health.FAILURE)
    counted = metrics.errors_by_type(dead_letters(decode_messages(messages_of(spark, [""]))), failures)
    assert {row.error_type: row.errors for row in counted.collect()} == {"empty_message_data": 1, "batch_processing_failed": 1}
