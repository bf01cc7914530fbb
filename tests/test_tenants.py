from conftest import KNOWN, NOW, SETTINGS, request, requests_of, rows_of, seconds
from pyspark.sql import functions as F

from eventloom.model import PROJECT
from eventloom.operators import projects as P
from eventloom.operators import quota, tenants


def candidate(n, name, plan="free", at=NOW):
    return (f"{KNOWN[:-3]}{n:03d}", name, plan, f"wk_test_{n}", at)


def load(spark, rows, existing=()):
    frame = spark.createDataFrame(rows, PROJECT)
    judged = P.judge_projects(frame, spark.createDataFrame(list(existing), PROJECT))
    return {int(r.project_id[-3:]): r for r in judged.collect()}


def test_project_rules(spark):
    rows = [
        candidate(1, "abc"),
        candidate(2, "ab"),
        candidate(3, "x" * 100),
        candidate(4, "x" * 101),
        candidate(5, "plan", plan="super"),
        candidate(6, "default", plan=None),
        candidate(7, "   "),
        candidate(8, None),
        candidate(9, " \tpadded\n "),
    ]
    judged = load(spark, rows)
    assert {n: r.code for n, r in judged.items() if r.code} == dict.fromkeys((2, 4, 5, 8), "ValidationError")
    assert judged[6].plan == "free" and judged[9].name == "padded"
    assert judged[7].name == "" and judged[7].empty_name
    kinds = {n: judged[n].errors[0].type for n in (2, 4, 5, 8)}
    assert kinds == {2: "string_too_short", 4: "string_too_long", 5: "enum", 8: "missing"}


def test_project_names_are_unique(spark):
    rows = [
        candidate(1, "same", at=NOW + seconds(1)),
        candidate(2, "same"),
        candidate(3, " same "),
        candidate(4, "taken"),
        candidate(5, "same", plan="bad", at=NOW - seconds(1)),
        candidate(9, "other"),
    ]
    judged = load(spark, rows, [candidate(9, "taken")])
    assert {n: r.code for n, r in judged.items()} == {
        1: "UnexpectedError",
        2: None,
        3: "UnexpectedError",
        4: "UnexpectedError",
        5: "ValidationError",
        9: "UnexpectedError",
    }
    frame = P.judge_projects(spark.createDataFrame(rows, PROJECT), spark.createDataFrame([], PROJECT))
    assert P.new_projects(frame).count() + P.refused_projects(frame).count() == len(rows)
    refused = P.refused_projects(frame).where("name = 'same' and code = 'UnexpectedError'").first()
    assert (refused.status, refused.message) == (500, "Unexpected Error")


def test_lookups(spark, projects):
    assert P.project_by_key(projects, "wk_test_2").first().name == "two"
    assert P.project_by_id(projects, KNOWN).first().name == "one"
    assert P.project_by_key(projects, "none").count() == 0


def test_repeated_key_does_not_multiply_requests(spark, projects):
    twice = projects.unionByName(projects.withColumn("project_id", F.lit("z")))
    resolved = tenants.resolve_tenants(requests_of(spark, [request("r", {})]), twice, SETTINGS)
    assert rows_of(resolved, "project_id") == [(KNOWN,)]


def test_referential_checks(spark, projects):
    events = spark.createDataFrame([(KNOWN, 1), ("gone", 2), (None, 3)], "project_id string, n int")
    assert rows_of(tenants.orphans(events, projects), "n") == [(2,), (3,)]
    assert rows_of(tenants.with_known_project(events, projects), "n") == [(1,)]
    removed = projects.where(F.col("name") == "one")
    assert rows_of(tenants.without_projects(events, removed), "n") == [(2,), (3,)]


def test_identity_and_limit(spark, projects):
    rows = [
        request("key", {}),
        request("pro", {}, api_key="wk_test_2"),
        request("enterprise", {}, api_key="wk_test_3"),
        request("none", {}, api_key=None),
        request("bad", {}, api_key="pk"),
        request("unknown", {}, api_key="wk_test_x"),
        request("hops", {}, api_key=None, forwarded=" 9.9.9.9 , 8.8.8.8"),
        request("blank-hops", {}, api_key=None, forwarded=""),
        request("nowhere", {}, api_key=None, ip=None),
    ]
    resolved = tenants.resolve_tenants(requests_of(spark, rows), projects, SETTINGS)
    found = quota.with_quota_identity(resolved, SETTINGS).collect()
    assert {r.request_id: (r.identity, r.quota) for r in found} == {
        "key": (f"project:{KNOWN}", 100),
        "pro": (f"project:{KNOWN[:-1]}2", 1000),
        "enterprise": (f"project:{KNOWN[:-1]}3", 10000),
        "none": ("ip:1.2.3.4", 10),
        "bad": ("ip:1.2.3.4", 10),
        "unknown": (None, None),
        "hops": ("ip:9.9.9.9", 10),
        "blank-hops": ("ip:1.2.3.4", 10),
        "nowhere": ("ip:unknown", 10),
    }


def test_unlisted_plan_gets_the_anonymous_limit(spark):
    plans = spark.createDataFrame([("free",), ("gold",), (None,)], "plan string")
    limits = plans.select(quota.plan_limit(F.col("plan"), SETTINGS)).collect()
    assert [row[0] for row in limits] == [100, 10, 10]
