import json
from dataclasses import replace

from conftest import KNOWN, NOW, SETTINGS, raw_event, request, requests_of, rows_of, seconds
from pyspark.sql import functions as F

from eventloom.operators.rejects import reject_records
from eventloom.plans.ingest import accepted_events, outcomes, receipts


def judge(spark, projects, rows, settings=SETTINGS):
    return outcomes(requests_of(spark, rows), projects, settings)


def verdicts(judged):
    rows = judged.select("request_id", "pos", "disposition", "code").collect()
    return {(row.request_id, row.pos): (row.disposition, row.code) for row in rows}


def test_batch_keeps_valid_items(spark, projects):
    body = {"events": [raw_event(), raw_event(event_type="invalid"), raw_event(event_type="purchase")]}
    judged = judge(spark, projects, [request("b", body, "batch")])
    assert verdicts(judged) == {
        ("b", 0): ("accepted", None),
        ("b", 1): ("dropped", "ValidationError"),
        ("b", 2): ("dropped", "ValidationError"),
    }
    receipt = receipts(judged).first()
    assert (receipt.status, receipt.n_accepted, receipt.n_dropped) == ("accepted", 1, 2)
    assert receipt.event_ids == [accepted_events(judged).first().event_id]


def test_unusable_batches(spark, projects):
    rows = [
        request("empty", {"events": []}, "batch"),
        request("all-bad", {"events": [raw_event(event_type="x"), {}]}, "batch"),
        request("no-list", {"events": "not a list"}, "batch"),
        request("absent", {}, "batch"),
        request("array", [], "batch"),
        request("null", {"events": None}, "batch"),
        request("broken", '{"events":[', "batch"),
        request("blank", "", "batch"),
        request("none", None, "batch"),
    ]
    judged = judge(spark, projects, rows)
    found = {r.request_id: r for r in receipts(judged).collect()}
    assert {r.code for r in found.values()} == {"ValidationError"}
    assert all(r.status is None and r.event_ids == [] for r in found.values())
    errors = {
        r.request_id: [(e.loc, e.type) for e in r.errors]
        for r in reject_records(judged).where("disposition = 'rejected'").collect()
    }
    assert errors == {
        "empty": [("body.events", "too_short")],
        "no-list": [("body.events", "list_type")],
        "absent": [("body.events", "missing")],
        "array": [("body", "model_attributes_type")],
        "null": [("body.events", "list_type")],
        "broken": [("body", "json_invalid")],
        "blank": [("body", "missing")],
        "none": [("body", "missing")],
    }


def test_batch_size_counts_valid_items_only(spark, projects):
    def body(valid, invalid):
        return {"events": [raw_event(event_type="x")] * invalid + [raw_event()] * valid}

    rows = [
        request("full", body(500, 0), "batch"),
        request("full-and-bad", body(500, 7), "batch"),
        request("over", body(501, 3), "batch"),
    ]
    judged = judge(spark, projects, rows)
    assert rows_of(judged.groupBy("request_id", "disposition").count(), "request_id", "disposition", "count") == [
        ("full", "accepted", 500),
        ("full-and-bad", "accepted", 500),
        ("full-and-bad", "dropped", 7),
        ("over", "dropped", 3),
        ("over", "rejected", 501),
    ]
    kinds = judged.where("request_id = 'over' and disposition = 'rejected'").select(F.col("errors.type")).distinct()
    assert [row[0] for row in kinds.collect()] == [["too_long"]]


def test_tenant_refusals_and_precedence(spark, projects):
    good, bad = raw_event(), raw_event(event_type="x")
    rows = [
        request("ok", good),
        request("no-key", good, api_key=None),
        request("blank-key", good, api_key=""),
        request("bad-key", good, api_key="pk_test_1"),
        request("unknown", good, api_key="wk_test_none"),
        request("prefix-only", good, api_key="wk_testless"),
        request("bad-event-no-key", bad, api_key=None),
        request("bad-json-no-key", "{", api_key=None),
        request("batch-no-key", {"events": [good, bad]}, "batch", api_key=None),
    ]
    judged = judge(spark, projects, rows)
    assert verdicts(judged) == {
        ("ok", 0): ("accepted", None),
        ("no-key", 0): ("rejected", "UnauthorizedError"),
        ("blank-key", 0): ("rejected", "UnauthorizedError"),
        ("bad-key", 0): ("rejected", "UnauthorizedError"),
        ("unknown", 0): ("rejected", "NotFoundError"),
        ("prefix-only", 0): ("rejected", "NotFoundError"),
        ("bad-event-no-key", 0): ("rejected", "ValidationError"),
        ("bad-json-no-key", 0): ("rejected", "ValidationError"),
        ("batch-no-key", 0): ("rejected", "UnauthorizedError"),
        ("batch-no-key", 1): ("dropped", "ValidationError"),
    }
    records = {(r.request_id, r.pos): r for r in reject_records(judged).collect()}
    assert records[("no-key", 0)].message == "Missing API Key"
    assert records[("bad-key", 0)].message == "Bad API Key"
    assert records[("unknown", 0)].message == "Project by api_key wk_test_none not Found"
    assert records[("bad-event-no-key", 0)].message == "Validation Error"
    assert {r.code: r.status for r in records.values()} == {
        "UnauthorizedError": 401,
        "NotFoundError": 404,
        "ValidationError": 422,
    }
    assert [tuple(e) for e in records[("batch-no-key", 1)].errors][0][0] == "body.events.1.event_type"
    assert {r.request_id: r.code for r in receipts(judged).collect()}["batch-no-key"] == "UnauthorizedError"


def test_quota_comes_between_body_and_fields(spark, projects):
    settings = replace(SETTINGS, quota_enabled=True, quota_free=2, quota_anonymous=1)
    rows = [
        request("broken", "{", at=NOW),
        request("a", raw_event(), at=NOW + seconds(1)),
        request("b", raw_event(event_type="x"), at=NOW + seconds(2)),
        request("c", raw_event(event_type="x"), at=NOW + seconds(3)),
        request("later", raw_event(), at=NOW + seconds(61)),
        request("anonymous-1", raw_event(), api_key=None, at=NOW),
        request("anonymous-2", raw_event(), api_key=None, at=NOW + seconds(1)),
        request("unknown", raw_event(event_type="x"), api_key="wk_test_none"),
    ]
    judged = judge(spark, projects, rows, settings)
    assert {k[0]: v[1] for k, v in verdicts(judged).items()} == {
        "broken": "ValidationError",
        "a": None,
        "b": "ValidationError",
        "c": "RateLimitExceededError",
        "later": None,
        "anonymous-1": "UnauthorizedError",
        "anonymous-2": "RateLimitExceededError",
        "unknown": "NotFoundError",
    }
    throttled = reject_records(judged).where("code = 'RateLimitExceededError'").first()
    assert (throttled.status, throttled.message) == (429, "Rate limit exceeded. Retry after 60 seconds.")


def test_every_item_is_either_accepted_or_refused(spark, projects):
    rows = [request(f"r{n}", raw_event(event_type="page_view" if n % 3 else "x")) for n in range(30)]
    rows += [request("b", {"events": [raw_event(), {}, 5]}, "batch")]
    judged = judge(spark, projects, rows)
    accepted = judged.where("disposition = 'accepted'").select("request_id", "pos")
    refused = reject_records(judged).select("request_id", "pos")
    everything = judged.select("request_id", "pos")
    assert accepted.count() + refused.count() == everything.count() == 33
    assert everything.exceptAll(accepted.unionByName(refused)).count() == 0


def test_accepted_event_is_stamped(spark, projects):
    body = raw_event(
        event_type="purchase",
        user_id="u",
        properties={"product_id": "p", "price": 99.99, "quantity": 2, "page_url": "https://Shop.com"},
    )
    event = accepted_events(judge(spark, projects, [request("r", body)])).first()
    assert event.project_id == KNOWN and event.user_id == "u" and event.session_id is None
    assert (event.properties.price, event.properties.quantity) == (9999, 2)
    assert event.properties.page_url == "https://shop.com/"
    assert event.created_at == NOW.replace(tzinfo=None)


def test_a_filter_on_the_outcome_does_not_parse_twice(spark, projects):
    judged = judge(spark, projects, [request("r", json.dumps(raw_event()))])
    plan = accepted_events(judged)._jdf.queryExecution().optimizedPlan().toString()
    # once in the regular branch, and once in the branch of long bodies
    assert plan.count("parseJson") == 2


def test_long_lists_are_told_apart_before_items_are_checked(spark, projects):
    """So that no item is checked in a branch that does not keep it."""
    rows = [request(f"b{n}", {"events": [raw_event()] * n}, "batch") for n in range(1, 6)]
    judged = outcomes(requests_of(spark, rows), projects, replace(SETTINGS, max_batch=3))
    plan = judged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the first branch's filter stands below the checks, not right above the fence of checked items
    kept = next(line for line in plan if "Filter" in line)
    assert "struct(errors" not in plan[plan.index(kept) + 1]
    assert rows_of(judged.groupBy("request_id").agg(F.max("disposition").alias("d")), "request_id", "d") == [
        ("b1", "accepted"), ("b2", "accepted"), ("b3", "accepted"), ("b4", "rejected"), ("b5", "rejected")
    ]
