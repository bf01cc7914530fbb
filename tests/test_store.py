import json

import pytest
from conftest import KNOWN, NOW, seconds
from pyspark.sql import functions as F

from eventloom.model import EVENT, PROPERTY_NAMES
from eventloom.operators import metrics
from eventloom.operators.wire import dead_letters, decode_messages, decoded_events, encode_events
from eventloom.sources import raw, store
from eventloom.streaming.consume import store_batch

EMPTY = dict.fromkeys(PROPERTY_NAMES)


def event(n, project=KNOWN, event_type="click", at=NOW, **properties):
    event_id = f"018d5cd0-bc00-7000-8000-{n:012d}"
    return (event_id, project, None, None, event_type, at, {**EMPTY, **properties}, NOW)


def events_of(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def wire(n=1, **changes):
    message = {
        "event_id": f"018d5cd0-bc00-7000-8000-{n:012d}",
        "project_id": KNOWN,
        "event_type": "page_view",
        "timestamp": "2024-01-31T00:00:00+00:00",
        "created_at": "2024-01-31T00:00:00",
        "properties": {},
    }
    message.update(changes)
    return json.dumps({name: value for name, value in message.items() if value is not ...})


def messages_of(spark, texts):
    rows = [(f"m{n}", None if text is None else bytearray(text, "utf-8")) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "msg_id string, data binary")


def test_events_survive_the_wire(spark):
    events = events_of(
        spark,
        [
            event(1, event_type="purchase", price=1250, quantity=2, product_name='né "q"'),
            event(2, event_type="page_view", at=NOW + seconds(0.25)),
        ],
    )
    encoded = encode_events(events)
    assert all(json.loads(row.data)["properties"].keys() == EMPTY.keys() for row in encoded.collect())
    log = encoded.select(F.col("event_id").alias("msg_id"), F.encode("data", "utf-8").alias("data"))
    back = decoded_events(decode_messages(log)).drop("msg_id")
    assert back.collect() == events.collect()


BAD = "DeserializationError: "


@pytest.mark.parametrize(
    "text, error",
    [
        (wire(), None),
        (wire(properties=...), None),
        (wire(event_id="{018D5CD0BC0070008000000000000001}"), None),
        (wire(timestamp="20240131T000000"), None),
        (wire(user_id=5, properties={"price": -1, "quantity": 99999, "currency": "x"}), None),
        ("", "empty_message_data"),
        (None, "empty_message_data"),
        ("not_json", BAD + "message is not valid JSON"),
        ("[1]", BAD + "message is not an object"),
        (wire(properties=None), BAD + "properties is not an object"),
        (wire(properties=[1]), BAD + "properties is not an object"),
        (wire(timestamp=...), BAD + "'timestamp'"),
        (wire(created_at=...), BAD + "'created_at'"),
        (wire(event_id=...), BAD + "'event_id'"),
        (wire(project_id=...), BAD + "'project_id'"),
        (wire(event_type=...), BAD + "'event_type'"),
        (wire(timestamp="x"), BAD + "Invalid isoformat string: 'x'"),
        (wire(project_id="x"), BAD + "badly formed hexadecimal UUID string"),
        (wire(event_type="x"), BAD + "'x' is not a valid EventType"),
        (wire(event_type="x", timestamp="y"), BAD + "Invalid isoformat string: 'y'"),
    ],
)
def test_decoding(spark, text, error):
    decoded = decode_messages(messages_of(spark, [text])).first()
    assert decoded.error == error
    assert (decoded.event is None) == (error is not None)


def test_dead_letters_keep_the_bytes(spark):
    letters = dead_letters(decode_messages(messages_of(spark, ["not_json", "", wire()])))
    found = {row.original_msg_id: row for row in letters.collect()}
    assert set(found) == {"m0", "m1"}
    assert bytes(found["m0"].raw_data) == b"not_json" and found["m0"].error_type == "deserialization"
    assert found["m1"].error_type == "empty_message_data" and found["m1"].failed_at is not None
    counts = {row.error_type: row.errors for row in metrics.errors_by_type(letters).collect()}
    assert counts == {"deserialization": 1, "empty_message_data": 1}


def test_store_ignores_known_ids(spark, folder):
    path = folder("store")
    assert store.read_events(spark, path).count() == 0
    store.append_events(events_of(spark, [event(1), event(2), event(1)]), path, 0)
    store.append_events(events_of(spark, [event(2), event(3)]), path, 1)
    store.append_events(events_of(spark, [event(3), event(2)]), path, 1)  # a replay
    stored = store.read_events(spark, path)
    assert sorted(int(row.event_id[-3:]) for row in stored.collect()) == [1, 2, 3]
    assert {int(row.event_id[-3:]): row.batch_id for row in stored.collect()} == {1: 0, 2: 0, 3: 1}


def test_known_days_are_taken(spark, folder):
    path = folder("store")
    day = NOW.date()
    for batch_id in (0, 1):
        store.append_events(events_of(spark, [event(1), event(2)]), path, batch_id, days=(day, day))
    assert store.read_events(spark, path).count() == 2


def test_an_empty_batch_stores_nothing(spark, folder):
    path = folder("store")
    store.append_events(events_of(spark, [event(1)]), path, 0)
    store.append_events(events_of(spark, []), path, 1)
    assert store.read_events(spark, path).count() == 1


def test_first_copy_wins(spark):
    frame = events_of(spark, [event(1, event_type=kind) for kind in ("b", "a", "c")])
    order = F.when(F.col("event_type") == "c", "m1").otherwise("m2")
    kept = store.first_copies(frame.withColumn("msg_id", order), "msg_id").collect()
    assert [row.event_type for row in kept] == ["c"]


def test_an_id_stored_under_another_day_is_found(spark, folder):
    path = folder("store")
    store.append_events(events_of(spark, [event(1)]), path, 0)
    moved = events_of(spark, [event(1, at=NOW - seconds(5 * 86_400))])
    store.append_events(moved, path, 1)
    assert store.read_events(spark, path).count() == 1


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def id_of(day, n, version=7):
    millis = f"{int((NOW - seconds(day * 86_400)).timestamp() * 1000):012x}"
    return f"{millis[:8]}-{millis[8:]}-{version}000-8000-{n:012d}"


def with_id(event_id, **changes):
    return (event_id, *event(1, **changes)[1:])


def test_only_slots_of_the_batch_are_searched(spark, folder, monkeypatch):
    path = folder("store")
    store.append_events(events_of(spark, [with_id(id_of(day, n)) for day in range(5) for n in range(3)]), path, 0)
    joined = []
    monkeypatch.setattr(store, "replace_events", lambda rows, *_: joined.append(rows))
    store.append_events(events_of(spark, [with_id(id_of(2, 1)), with_id(id_of(2, 7))]), path, 1)
    plan = plan_of(joined[0])
    pruned = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("id_slot" in x and "d20240129" in x for x in pruned)
    assert all("d20240130" not in x and "d20240128" not in x for x in pruned)
    assert [row.event_id for row in joined[0].collect()] == [id_of(2, 7)]
    monkeypatch.undo()
    found = {row.id_slot for row in store.read_events(spark, path).collect()}
    assert found == {"d20240127", "d20240128", "d20240129", "d20240130", "d20240131"}


def test_slots_of_other_ids(spark, folder):
    path = folder("store")
    ids = [id_of(0, 1, version=4), f"{0:08x}-0000-7000-8000-{1:012d}", "ffffffff-ffff-7000-8000-000000000001", "anything"]
    for batch_id in range(2):
        rows = [with_id(x, at=NOW - seconds(batch_id * 86_400)) for x in ids for _ in range(batch_id + 1)]
        store.append_events(events_of(spark, rows), path, batch_id)
    stored = store.read_events(spark, path)
    assert sorted(row.event_id for row in stored.collect()) == sorted(ids)
    assert all(row.id_slot[0] == "h" for row in stored.collect())
    for x in ids:
        assert store.get_event(stored, x).event_id == x


def test_a_lookup_skips_row_groups_by_the_filters_of_their_ids(spark, folder):
    path = folder("store")
    ids = [id_of(0, 7919 * n % 1_000_003, version=4) for n in range(40_000)]
    rows = spark.createDataFrame([(x,) for x in ids], "event_id string")
    full = events_of(spark, [event(1)]).drop("event_id").crossJoin(rows).select(*EVENT.fieldNames())
    for batch_id in range(4):
        store.append_events(full.where(F.pmod(F.hash("event_id"), F.lit(4)) == batch_id), path, batch_id)
    found = store.event_by_id(store.read_events(spark, path), ids[5])
    assert found.count() == 1
    found.collect()
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert 1 <= read <= 4_000  # of 5,000 in the slot, spread over four batches, few row groups can hold it
    assert "id_slot" in plan_of(found).split("PartitionFilters:")[1].split("]")[0]


def test_a_failed_write_leaves_the_batch_as_it_was(spark, folder):
    path = folder("store")
    store.append_events(events_of(spark, [event(1)]), path, 0)
    bad = events_of(spark, [event(2)]).withColumn("user_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.append_events(bad, path, 0)
    assert [row.event_id for row in store.read_events(spark, path).collect()] == [event(1)[0]]
    store.append_events(events_of(spark, [event(3)]), path, 0)
    assert [row.event_id for row in store.read_events(spark, path).collect()] == [event(3)[0]]


def test_reads(spark, folder):
    path = folder("store")
    other = KNOWN[:-1] + "2"
    rows = [event(n, at=NOW + seconds(100 - n // 2)) for n in range(20)] + [event(99, project=other)]
    store.append_events(events_of(spark, rows), path, 0)
    stored = store.read_events(spark, path)
    in_order = [row.event_id for row in store.project_page(stored, KNOWN, limit=20).collect()]
    expected = sorted(rows[:20], key=lambda row: (row[5], row[0]))
    assert in_order == [row[0] for row in expected]
    pages = [store.project_page(stored, KNOWN, limit=7, offset=offset).collect() for offset in (0, 7, 14, 21)]
    assert [row.event_id for page in pages for row in page] == in_order
    assert [len(page) for page in pages] == [7, 7, 6, 0]
    assert store.project_page(stored, other).count() == 1
    found = store.get_event(stored, rows[0][0])
    assert found.event_type == "click" and found.user_id is None and found.properties.price is None
    with pytest.raises(store.NotFoundError, match="Event by id nothing not found"):
        store.get_event(stored, "nothing")


def test_slice_reads_only_its_days(spark, folder):
    path = folder("store")
    rows = [event(n, event_type="purchase" if n % 2 else "click", at=NOW - seconds(n * 43_200)) for n in range(20)]
    store.append_events(events_of(spark, rows), path, 0)
    start, end = F.lit("2024-01-25").cast("timestamp"), F.lit("2024-01-27 12:00:00").cast("timestamp")
    sliced = store.time_slice(store.read_events(spark, path), start, end, "purchase")
    assert sorted(row.timestamp.day for row in sliced.collect()) == [25, 26]
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "EqualTo(event_type,purchase)" in plan.split("PushedFilters:")[1]


def test_orphans_become_dead_letters(spark, folder, projects):
    events, letters = folder("events"), folder("letters")
    batch = messages_of(spark, [wire(1), wire(2, project_id=KNOWN[:-1] + "9"), "not_json"])
    for _ in range(2):
        store_batch(batch, 0, events, letters, projects)
    assert store.read_events(spark, events).count() == 1
    errors = {row.error for row in store.read_dead_letters(spark, letters).collect()}
    assert errors == {BAD + "message is not valid JSON", f"Project by id {KNOWN[:-1]}9 not found"}


def test_legacy_rows(spark):
    rows = [(1, 2, "click", '{"a":1}', '{"a":2}', None), (1, 2, None, None, '{"a":2}', None)]
    schema = "user_id int, session_id int, event_type string, properties string, user_properties string, device string"
    folded = store.fold_legacy_columns(spark.createDataFrame(rows, schema))
    assert folded.columns == ["user_id", "session_id", "event_type", "properties"]
    assert [tuple(row) for row in folded.collect()] == [("1", "2", "click", '{"a":2}'), ("1", "2", None, None)]


def test_file_log(spark, folder):
    path = folder("log")
    raw.write_messages(encode_events(events_of(spark, [event(1, event_type="page_view")])), path)
    assert decode_messages(raw.read_messages(spark, path)).first().error is None
    with pytest.raises(ValueError, match="format must be one of"):
        raw.read_messages(spark, path, "csv")
    assert raw.kafka_options("h:1", "t", 5)["startingOffsets"] == "earliest"


def test_histogram_is_cumulative(spark):
    frame = spark.createDataFrame([(v,) for v in (0.01, 0.02, 0.3, 7.0, 11.0, None)], "v double")
    rows = metrics.histogram_le(frame, F.col("v")).collect()
    assert [(row.le, row.n) for row in rows] == [
        ("0.01", 1), ("0.05", 2), ("0.1", 2), ("0.5", 3), ("1.0", 3), ("2.5", 3), ("5.0", 3), ("10.0", 4), ("+Inf", 5),
    ]
    assert rows[0]["count"] == 5 and rows[0]["sum"] == pytest.approx(18.33)


def test_rates(spark):
    samples = spark.createDataFrame(
        [(NOW + seconds(s), total, latency) for s, total, latency in
         [(0, 0, 90.0), (60, 50, 80.0), (61, 60, 10.0), (62, 75, 20.0), (65, 90, 30.0)]],
        "at timestamp, total long, latency double",
    )
    row = metrics.steady_state_rate(samples, 60).first()
    assert (row.average_rate, row.average_latency) == (15.0, 20.0)
    sent = spark.createDataFrame([(NOW, 1), (NOW + seconds(0.5), 20), (NOW + seconds(1), 1)], "at timestamp, n int")
    rate = metrics.delivered_throughput(sent, F.col("at"), F.col("n")).orderBy("second").collect()
    assert [(row.requests, row.events) for row in rate] == [(2, 21), (1, 1)]
