"""One registered query per operator, each over whole given tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import times
from eventloom.functions.ids import event_key
from eventloom.functions.money import minor_units
from eventloom.functions.urls import with_url
from eventloom.model import PROPERTY_NAMES, REJECT_STATUS
from eventloom.operators import analytics, metrics, quota, tenants
from eventloom.operators.projects import project_by_key
from eventloom.operators.rejects import default_message, reject_records, status_of
from eventloom.operators.validate import check_events, consistency_rule, time_rule
from eventloom.operators.wire import decode_messages, decoded_events, encode_events
from eventloom.plans.ingest import accepted_events, outcomes, receipts
from eventloom.plans.scratch import fresh_path
from eventloom.registry import inputs
from eventloom.registry.inputs import SETTINGS, as_of, events_table, stored_events
from eventloom.settings import configure
from eventloom.sources import store
from eventloom.sources.dimension import load_projects, read_projects, remove_projects
from eventloom.streaming import consume, health
from eventloom.streaming.meter import metered_stream
from eventloom.streaming.quota import quota_batch
from eventloom.streaming.state import state_on_disk

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}

# Limits that the sparse given events exceed often enough to matter.
DAY_QUOTA = replace(
    SETTINGS,
    quota_enabled=True,
    quota_window_seconds=86_400,
    quota_free=5,
    quota_pro=10,
    quota_enterprise=20,
    quota_anonymous=10,
)
ANCHORED_QUOTA = replace(
    DAY_QUOTA, quota_window_seconds=21_600, quota_free=2, quota_pro=4, quota_enterprise=6, quota_anonymous=3
)
SMALL_BATCHES = replace(SETTINGS, max_batch=3)


def registered(name: str) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(configure(spark), sf_dir)

        _registry[name] = run
        return query

    return register


def queries() -> dict[str, Query]:
    return dict(_registry)


def _text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _error_texts(errors: str | Column) -> Column:
    return F.array_join(
        F.transform(errors, lambda e: F.concat_ws("|", e.loc, e.type, e.msg)), ";"
    )


def _single_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.single_requests(events_table(spark, sf_dir))
    return outcomes(requests, inputs.projects(spark, sf_dir), SETTINGS)


def _batch_outcomes(spark: SparkSession, sf_dir: str, settings=SETTINGS) -> DataFrame:
    requests = inputs.batch_requests(events_table(spark, sf_dir))
    return outcomes(requests, inputs.projects(spark, sf_dir), settings)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.single_requests(events_table(spark, sf_dir))
    items = requests.withColumn("item", F.try_parse_json("body")).withColumnRenamed("body", "item_text")
    return check_events(items, SETTINGS)


def _event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "project_id",
        "user_id",
        "session_id",
        "event_type",
        _text(F.col("timestamp")).alias("event_time"),
        F.col("properties.price").alias("price"),
        F.col("properties.quantity").cast("long").alias("quantity"),
        F.col("properties.page_url").alias("page_url"),
        _text(F.col("created_at")).alias("ingested_at"),
    )


# --- write path ---------------------------------------------------------------


@registered("accepted_summary")
def accepted_summary(spark, sf_dir):
    """Accepted events and purchase revenue per project and event type."""
    events = accepted_events(_single_outcomes(spark, sf_dir))
    bought = F.when(
        F.col("event_type") == "purchase", F.col("properties.price") * F.col("properties.quantity")
    )
    return events.groupBy("project_id", "event_type").agg(
        F.count("*").alias("events"), F.coalesce(F.sum(bought), F.lit(0)).alias("revenue")
    )


@registered("ingest_single")
def ingest_single(spark, sf_dir):
    judged = _single_outcomes(spark, sf_dir)
    return judged.select(
        "request_id",
        F.coalesce(status_of(F.col("code")), F.lit(202)).cast("long").alias("http_status"),
        F.when(F.col("disposition") == "accepted", "accepted").otherwise(F.col("code")).alias("result"),
        F.coalesce("event_id", F.lit("")).alias("event_id"),
    )


@registered("ingest_batch")
def ingest_batch(spark, sf_dir):
    return receipts(_batch_outcomes(spark, sf_dir)).select(
        "request_id",
        F.coalesce(status_of(F.col("code")), F.lit(202)).cast("long").alias("http_status"),
        F.coalesce("status", "code").alias("result"),
        "n_accepted",
        "n_dropped",
        F.size("event_ids").cast("long").alias("n_ids"),
    )


@registered("batch_receipts")
def batch_receipts(spark, sf_dir):
    accepted = receipts(_batch_outcomes(spark, sf_dir)).where(F.col("status") == "accepted")
    return accepted.select("request_id", "status", F.array_join("event_ids", ",").alias("event_ids"))


@registered("batch_size_check")
def batch_size_check(spark, sf_dir):
    """Verdict per batch, at a limit low enough that some batches break it."""
    judged = _batch_outcomes(spark, sf_dir, SMALL_BATCHES)
    verdict = (
        F.when(F.max(F.try_element_at("errors.type", F.lit(1)) == "too_long"), "too_long")
        .when(F.count_if(F.col("disposition") != "dropped") == 0, "too_short")
        .otherwise("ok")
    )
    return judged.groupBy("request_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("disposition") != "dropped").alias("n_valid"),
        verdict.alias("verdict"),
    )


@registered("batch_junk_items")
def batch_junk_items(spark, sf_dir):
    """Verdict per batch whose events are each followed by short items that are none, at the low limit."""
    raw = inputs.raw_bodies(events_table(spark, sf_dir))
    junk = F.concat(F.col("raw"), F.repeat(F.lit(",1"), (F.col("event_id") % 4).cast("int")))
    requests = inputs.batch_requests(events_table(spark, sf_dir), raw.withColumn("raw", junk))
    judged = outcomes(requests, inputs.projects(spark, sf_dir), SMALL_BATCHES)
    too_long = F.max(F.try_element_at("errors.type", F.lit(1)) == "too_long")
    return judged.groupBy("request_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("disposition") != "dropped").alias("n_valid"),
        F.when(too_long, "too_long").otherwise("ok").alias("verdict"),
    )


@registered("ingest_metered")
def ingest_metered(spark, sf_dir):
    """The write path with quotas on: even users post singly, odd ones in batches, all in one window."""
    mapped = events_table(spark, sf_dir)
    alone = inputs.single_requests(mapped.where(F.col("user_id") % 2 == 0))
    together = inputs.batch_requests(mapped.where(F.col("user_id") % 2 == 1))
    judged = outcomes(alone.unionByName(together), inputs.projects(spark, sf_dir), DAY_QUOTA)
    return receipts(judged).select(
        "request_id",
        F.coalesce(status_of(F.col("code")), F.lit(202)).cast("long").alias("http_status"),
        F.coalesce("status", "code").alias("result"),
        "n_accepted",
    )


@registered("accepted_events")
def accepted_events_log(spark, sf_dir):
    """Single and batch requests feed one log: even users post singly, odd ones in batches."""
    mapped = events_table(spark, sf_dir)
    alone = inputs.single_requests(mapped.where(F.col("user_id") % 2 == 0))
    together = inputs.batch_requests(mapped.where(F.col("user_id") % 2 == 1))
    judged = outcomes(alone.unionByName(together), inputs.projects(spark, sf_dir), SETTINGS)
    return _event_columns(accepted_events(judged))


@registered("rejects")
def rejects(spark, sf_dir):
    judged = _single_outcomes(spark, sf_dir).unionByName(_batch_outcomes(spark, sf_dir))
    return reject_records(judged).select(
        "request_id",
        F.col("pos").cast("long").alias("pos"),
        "disposition",
        "code",
        "message",
        F.col("status").cast("long").alias("status"),
        _error_texts("errors").alias("errors"),
    )


@registered("reject_status")
def reject_status(spark, sf_dir):
    records = reject_records(_single_outcomes(spark, sf_dir))
    return records.groupBy("code", F.col("status").cast("long").alias("status")).agg(
        F.count("*").alias("n")
    )


@registered("reject_message")
def reject_message(spark, sf_dir):
    """Default message of every code, the codes being dealt out over all events."""
    codes = F.array(*[F.lit(code) for code in REJECT_STATUS])
    code = F.element_at(codes, (F.col("event_id") % len(REJECT_STATUS) + 1).cast("int"))
    dealt = events_table(spark, sf_dir).select(code.alias("code"))
    return dealt.groupBy("code", default_message(F.col("code")).alias("message")).agg(
        F.count("*").alias("n")
    )


# --- projections --------------------------------------------------------------


@registered("normalize_properties")
def normalize_properties(spark, sf_dir):
    checked = _checked(spark, sf_dir).where(F.size("errors") == 0)
    inner = [F.coalesce(F.col(f"event.properties.{name}").cast("string"), F.lit("-")).alias(name) for name in PROPERTY_NAMES]
    return checked.select("request_id", *inner)


@registered("price_minor")
def price_minor(spark, sf_dir):
    return events_table(spark, sf_dir).select("event_id", minor_units(F.col("value")).alias("price_minor"))


@registered("enrich_event")
def enrich_event(spark, sf_dir):
    return accepted_events(_single_outcomes(spark, sf_dir)).select(
        "event_id", "project_id", _text(F.col("created_at")).alias("ingested_at")
    )


@registered("event_key")
def event_key_ids(spark, sf_dir):
    return events_table(spark, sf_dir).select(
        "event_id",
        event_key(F.col("ts"), F.col("event_id").cast("string"), F.col("event_id") % 7).alias("key"),
    )


@registered("normalize_ts")
def normalize_ts(spark, sf_dir):
    """Six spellings of the event time, by event id."""
    ts, form = F.col("ts"), F.col("event_id") % 6
    text = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0230'"))
        .when(form == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 3, F.unix_seconds(ts).cast("string"))
        .when(form == 4, F.unix_millis(ts).cast("string"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    return events_table(spark, sf_dir).select(
        "event_id", _text(times.parse_edge_time(text)).alias("event_time")
    )


@registered("normalize_week_dates")
def normalize_week_dates(spark, sf_dir):
    """Four spellings of the event's week date, and one that is none, by event id."""
    ts, form = F.col("ts"), F.col("event_id") % 5
    day = F.weekday(ts) + 1
    year = F.year(F.date_add(F.to_date(ts), F.lit(3) - F.weekday(ts)))
    week = F.lpad(F.weekofyear(ts).cast("string"), 2, "0")
    text = (
        F.when(form == 0, F.concat(year, F.lit("-W"), week, F.lit("-"), day))
        .when(form == 1, F.concat(year, F.lit("W"), week, day))
        .when(form == 2, F.concat(year, F.lit("-W"), week))
        .when(form == 3, F.concat(year, F.lit("W"), week, day, F.date_format(ts, "'T'HH:mm:ss'+01:00'")))
        .otherwise(F.concat(year, F.lit("-W53-"), day))
    )
    return events_table(spark, sf_dir).select(
        "event_id", F.coalesce(_text(times.parse_wire_time(text)), F.lit("-")).alias("event_time")
    )


@registered("quota_identity")
def quota_identity(spark, sf_dir):
    n, k = F.col("event_id"), F.col("k")
    forwarded = (
        F.when(n % 4 == 1, "")
        .when(n % 4 == 2, F.concat(F.lit("10.0.0."), k, F.lit(", 1.1.1.1")))
        .when(n % 4 == 3, F.concat(F.lit(" 10.1.0."), k, F.lit(" ,x")))
    )
    peer = F.when(n % 3 != 0, F.concat(F.lit("192.168.0."), k))
    return events_table(spark, sf_dir).select(
        "event_id",
        quota.address_identity(forwarded, peer).alias("identity"),
        quota.creation_identity(peer).alias("creation_identity"),
    )


@registered("props_backfill")
def props_backfill(spark, sf_dir):
    n, k = F.col("event_id"), F.col("k")
    product = F.concat(F.lit('{"product_id":"p'), k, F.lit('","browser":"old"}'))
    person = F.concat(F.lit('{"country":"C'), k % 5, F.lit('","browser":"new"}'))
    device = F.concat(F.lit('{"os":"O'), k % 3, F.lit('","browser":null}'))
    legacy = events_table(spark, sf_dir).select(
        "event_id",
        "user_id",
        F.col("session").alias("session_id"),
        "event_type",
        F.when(n % 7 != 0, product).alias("properties"),
        F.when(n % 3 != 0, person).alias("user_properties"),
        F.when(n % 4 == 0, device).alias("device"),
    )
    folded = store.fold_legacy_columns(legacy)

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object("properties", f"$.{name}"), F.lit("-")).alias(name)

    return folded.select(
        "event_id",
        "user_id",
        field("product_id"),
        field("browser"),
        field("country"),
        field("os"),
        F.coalesce(F.size(F.json_object_keys("properties")), F.lit(-1)).cast("long").alias("n_keys"),
    )


# --- validation ---------------------------------------------------------------


@registered("validate_events")
def validate_events(spark, sf_dir):
    return _checked(spark, sf_dir).select(
        "request_id", F.size("errors").cast("long").alias("n_errors"), _error_texts("errors").alias("errors")
    )


@registered("validate_time")
def validate_time(spark, sf_dir):
    timed = events_table(spark, sf_dir).withColumn("timestamp", inputs.raw_time())
    failed = time_rule(F.col("timestamp"), as_of(), SETTINGS)
    return timed.select("event_id", F.coalesce(failed["msg"], F.lit("ok")).alias("verdict"))


@registered("validate_props")
def validate_props(spark, sf_dir):
    """Property rules and lenient readings, one variation per event by its id."""
    variations = [
        '"product_id":""',
        '"product_id":"{101}"',
        '"product_name":"{501}"',
        '"category":"{200}"',
        '"currency":"usd"',
        '"country":"USA"',
        '"device_type":"tv"',
        '"price":" 12.5 "',
        '"price":0',
        '"price":1000000.5',
        '"price":"abc"',
        '"quantity":10001',
        '"quantity":3.5',
        '"quantity":"3.0"',
        '"quantity":true',
        '"browser":5',
        '"os":null',
        '"button_clicked":"{100}"',
        '"source":["x"]',
        '"price":{}',
    ]
    texts = []
    for variation in variations:
        for size in (100, 101, 200, 501):
            variation = variation.replace(f"{{{size}}}", "é" * size)
        texts.append(F.lit(variation))
    chosen = F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = F.concat(
        F.lit('{"event_type":"page_view","timestamp":"'), time, F.lit('","properties":{'), chosen, F.lit("}}")
    )
    items = events_table(spark, sf_dir).select(
        "event_id",
        as_of().alias("received_at"),
        F.try_parse_json(body).alias("item"),
        body.alias("item_text"),
    )
    return check_events(items, SETTINGS).select(
        "event_id",
        _error_texts("errors").alias("errors"),
        F.coalesce("event.properties.price", F.lit(-1)).alias("price"),
        F.coalesce("event.properties.quantity", F.lit(-1)).cast("long").alias("quantity"),
    )


@registered("validate_url")
def validate_url(spark, sf_dir):
    """Spellings of page addresses, by event id."""
    k = F.col("k").cast("string")
    forms = [
        F.concat(F.lit("https://shop.example.com/p/"), k),
        F.concat(F.lit("HTTPS://Shop.Example.COM:443/P/"), k),
        F.concat(F.lit("http://shop.example.com:80?q="), k, F.lit(" x")),
        F.concat(F.lit("http://shop.example.com:8080/a b/"), k, F.lit("#top")),
        F.concat(F.lit(" https://shop.example.com/a/../b/./"), k, F.lit(" ")),
        F.concat(F.lit("ftp://shop.example.com/"), k),
        F.concat(F.lit("shop.example.com/"), k),
        F.concat(F.lit("https:///"), k, F.lit(".example.com/é")),
        F.concat(F.lit("https://user:@shop.example.com:99999/"), k),
        F.concat(F.lit("https://user:pw@10.0.0."), k),
    ]
    address = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    given = events_table(spark, sf_dir).select("event_id", address.alias("address"))
    return with_url(given, "address", "url").select(
        "event_id",
        F.coalesce("url", F.lit("-")).alias("url"),
        F.coalesce("url_problem", F.lit("ok")).alias("problem"),
    )


@registered("validate_hosts")
def validate_hosts(spark, sf_dir):
    """Internationalised host names, by event id."""
    k = F.col("k").cast("string")
    forms = [
        F.concat(F.lit("https://bücher.example/"), k),
        F.concat(F.lit("https://BÜCHER.example/"), k),
        F.concat(F.lit("https://b%C3%BCcher.example/"), k),
        F.concat(F.lit("https://例え。テスト/"), k),
        F.concat(F.lit("https://user@пример.рф:8080/"), k),
        F.concat(F.lit("https://１０.0.0.1/"), k),
        F.concat(F.lit("https://straße.example/"), k),
        F.concat(F.lit("https://shop."), F.repeat(F.lit("ü"), 70), F.lit(".example/"), k),
    ]
    address = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    given = events_table(spark, sf_dir).select("event_id", address.alias("address"))
    return with_url(given, "address", "url").select(
        "event_id",
        F.coalesce("url", F.lit("-")).alias("url"),
        F.coalesce("url_problem", F.lit("ok")).alias("problem"),
    )


@registered("validate_consistency")
def validate_consistency(spark, sf_dir):
    n = F.col("event_id")
    product = F.when(n % 3 != 0, F.lit("p"))
    price = F.when(n % 4 != 0, F.lit(1.0))
    quantity = F.when(n % 5 != 0, F.lit(1))
    failed = consistency_rule(F.col("mapped_type"), product, price, quantity)
    return events_table(spark, sf_dir).select(
        "event_id", F.coalesce(failed["msg"], F.lit("ok")).alias("verdict")
    )


# --- tenants and quotas -------------------------------------------------------


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.metered_requests(events_table(spark, sf_dir))
    return tenants.resolve_tenants(requests, inputs.projects(spark, sf_dir), SETTINGS)


@registered("tenant_resolve")
def tenant_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "request_id",
        F.coalesce("project_id", F.lit("-")).alias("project_id"),
        F.coalesce("tenant_code", F.lit("-")).alias("code"),
        F.coalesce("tenant_message", F.lit("-")).alias("message"),
    )


@registered("quota_limit")
def quota_limit(spark, sf_dir):
    return quota.with_quota_identity(_resolved(spark, sf_dir), SETTINGS).select(
        "request_id",
        F.coalesce("identity", F.lit("-")).alias("identity"),
        F.coalesce("quota", F.lit(-1)).cast("long").alias("quota"),
    )


def _decisions(judged: DataFrame) -> DataFrame:
    return judged.select(
        "request_id",
        F.coalesce("identity", F.lit("-")).alias("identity"),
        F.when(F.col("identity").isNotNull(), _text(F.col("window_start"))).otherwise("-").alias("window_start"),
        F.when(F.col("admitted"), 1).otherwise(0).cast("long").alias("admitted"),
    )


@registered("quota_fixed_window")
def quota_fixed_window(spark, sf_dir):
    identified = quota.with_quota_identity(_resolved(spark, sf_dir), DAY_QUOTA)
    return _decisions(quota.fixed_window_quota(identified, DAY_QUOTA))


@registered("quota_project_create")
def quota_project_create(spark, sf_dir):
    """Every event as an attempt to create a project, half of them without a key."""
    requests = inputs.metered_requests(events_table(spark, sf_dir))
    keyless = F.when(F.col("request_id").cast("long") % 2 == 0, F.col("api_key"))
    return _decisions(quota.creation_quota(requests.withColumn("api_key", keyless), DAY_QUOTA))


@registered("quota_anchored_window")
def quota_anchored_window(spark, sf_dir):
    identified = quota.with_quota_identity(_resolved(spark, sf_dir), ANCHORED_QUOTA)
    return _decisions(quota.anchored_window_quota(identified, ANCHORED_QUOTA))


@registered("orphan_events")
def orphan_events(spark, sf_dir):
    events = inputs.typed_events(events_table(spark, sf_dir))
    return _event_columns(tenants.orphans(events, _known_projects(spark, sf_dir)))


@registered("cascade_delete")
def cascade_delete(spark, sf_dir):
    """A store of two batches, rewritten without every fifth project."""
    path, events = fresh_path(spark, "store"), stored_events(spark, sf_dir)
    for batch_id in (0, 1):
        store.append_events(events.where(F.dayofmonth("timestamp") % 2 == batch_id), path, batch_id)
    removed = inputs.projects(spark, sf_dir).where(F.substring("project_id", -12, 12).cast("int") % 5 == 0)
    remove_projects(removed, path, fresh_path(spark, "staging"))
    return _event_columns(store.read_events(spark, path))


@registered("project_load")
def project_load(spark, sf_dir):
    base = inputs.projects(spark, sf_dir)
    number = F.substring("project_id", -12, 12).cast("int")
    later = F.lit("2024-01-02 00:00:00").cast("timestamp")

    def derived(rows: DataFrame, shift: int, **changes: Column) -> DataFrame:
        return rows.withColumns(
            {"project_id": inputs.project_id(number + shift), "created_at": later, **changes}
        )

    clashing = derived(base.where(number % 4 == 0), 100)
    short_name = derived(base.where(number == 0), 200, name=F.lit("ab"))
    odd_plan = derived(base.where(number == 1), 200, plan=F.lit("super"))
    padded = derived(
        base, 300, name=F.concat(F.lit(" \t"), "name", F.lit(" two\n")), plan=F.lit(None).cast("string")
    )
    candidates = base.unionByName(clashing).unionByName(short_name).unionByName(odd_plan).unionByName(padded)
    path = fresh_path(spark, "projects")
    judged = load_projects(candidates, path, batch_id=0)
    kept = read_projects(spark, path).select("project_id", F.lit("stored").alias("_kept"))
    return judged.join(kept, "project_id", "left").select(
        "project_id",
        "name",
        "plan",
        F.coalesce("code", "_kept", F.lit("lost")).alias("outcome"),
        _error_texts("errors").alias("errors"),
    )


@registered("project_by_key")
def project_lookup(spark, sf_dir):
    found = project_by_key(inputs.projects(spark, sf_dir), "wk_test_7")
    return found.select("project_id", "name", "plan", "api_key", _text(F.col("created_at")).alias("created"))


# --- log, store and reads -----------------------------------------------------


@registered("publish_wire")
def publish_wire(spark, sf_dir):
    return encode_events(inputs.typed_events(events_table(spark, sf_dir)))


@registered("decode_wire")
def decode_wire(spark, sf_dir):
    decoded = decode_messages(inputs.messages(events_table(spark, sf_dir)))
    return decoded.select(
        "msg_id",
        F.coalesce("error", F.lit("-")).alias("error"),
        F.coalesce("event.event_id", F.lit("-")).alias("event_id"),
        F.coalesce("event.event_type", F.lit("-")).alias("event_type"),
        F.coalesce(_text(F.col("event.timestamp")), F.lit("-")).alias("event_time"),
        F.coalesce("event.properties.price", F.lit(-1)).alias("price"),
        F.coalesce("event.properties.category", F.lit("-")).alias("category"),
    )


@registered("decode_stored")
def decode_stored(spark, sf_dir):
    typed = inputs.typed_events(events_table(spark, sf_dir))
    legacy = typed.withColumn("properties", F.to_json("properties", {"ignoreNullFields": "false"}))
    return _event_columns(store.decode_stored(legacy))


@registered("store_events")
def store_events(spark, sf_dir):
    """The same accepted events stored twice; the second load adds none."""
    path = fresh_path(spark, "store")
    first = stored_events(spark, sf_dir)
    store.append_events(first, path, batch_id=0)
    store.append_events(first, path, batch_id=1)
    return _event_columns(store.read_events(spark, path))


@registered("ingest_store")
def ingest_store(spark, sf_dir):
    """The whole write path into a fresh store, then its size per day."""
    path = fresh_path(spark, "store")
    store.append_events(accepted_events(_single_outcomes(spark, sf_dir)), path, batch_id=0)
    stored = store.read_events(spark, path)
    return stored.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events")
    )


@registered("events_page")
def events_page(spark, sf_dir):
    page = store.project_page(
        stored_events(spark, sf_dir), "00000000-0000-7000-8000-000000000003", limit=100, offset=20
    )
    return _event_columns(page)


def key_of_request(request_id: str) -> str:
    """The id `event_key` gives to a single request received at the as-of time."""
    digest = hashlib.sha256(f"{request_id}:0".encode()).hexdigest()
    variant = "89ab"[int(digest[0], 16) % 4]
    return f"018d5cd0-bc00-7000-{variant}{digest[1:4]}-{digest[4:16]}"


@registered("events_page_after")
def events_page_after(spark, sf_dir):
    """The page that follows a time, whatever number of events precedes it."""
    after = (datetime(2024, 1, 10, 12, tzinfo=timezone.utc), "")
    page = store.page_after(stored_events(spark, sf_dir), "00000000-0000-7000-8000-000000000003", after, limit=50)
    return _event_columns(page)


@registered("event_by_id")
def event_lookup(spark, sf_dir):
    return _event_columns(store.event_by_id(stored_events(spark, sf_dir), key_of_request("1"), SETTINGS))


@registered("events_slice")
def events_slice(spark, sf_dir):
    start, end = F.lit("2024-01-10 06:00:00"), F.lit("2024-01-12 18:00:00")
    sliced = store.time_slice(
        stored_events(spark, sf_dir), start.cast("timestamp"), end.cast("timestamp"), "purchase"
    )
    return _event_columns(sliced)


# --- streams ------------------------------------------------------------------


class _Consumed:
    """A finished run of the consumer over the events table, its health written by a listener."""

    def __init__(self, spark: SparkSession, sf_dir: str, projects: DataFrame | None = None) -> None:
        self.events = fresh_path(spark, "consumed")
        self.letters = fresh_path(spark, "dead-letters")
        self.health = fresh_path(spark, "health")
        listener = health.HealthLog(spark, self.health)
        spark.streams.addListener(listener)
        try:
            stream = inputs.messages(inputs.stream_events(spark, sf_dir))
            query = consume.consume(stream, self.events, self.letters, fresh_path(spark, "checkpoint"), projects)
            query.awaitTermination()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()  # reports come after the batches they are on
        finally:
            spark.streams.removeListener(listener)


_runs: dict[tuple[str, str], _Consumed] = {}


def _consumed(spark: SparkSession, sf_dir: str) -> _Consumed:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        _runs[key] = _Consumed(spark, sf_dir)
    return _runs[key]


@registered("stream_consume")
def stream_consume(spark, sf_dir):
    return _event_columns(store.read_events(spark, _Consumed(spark, sf_dir).events))


@registered("stream_store")
def stream_store(spark, sf_dir):
    """A replayed micro-batch and a redelivering one leave the store as it was."""
    path, letters = fresh_path(spark, "store"), fresh_path(spark, "dead-letters")
    stream = inputs.messages(inputs.stream_events(spark, sf_dir))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        for attempt in (0, 0, 1):
            consume.store_batch(batch, 10 * batch_id + attempt, path, letters)

    consume.start(stream, deliver, fresh_path(spark, "checkpoint")).awaitTermination()
    return _event_columns(store.read_events(spark, path))


@registered("dead_letters")
def dead_letters(spark, sf_dir):
    letters = store.read_dead_letters(spark, _consumed(spark, sf_dir).letters)
    return letters.select(
        "original_msg_id", "error", "error_type", F.col("raw_data").cast("string").alias("raw")
    )


@registered("stream_dedup")
def stream_dedup(spark, sf_dir):
    """Duplicates removed by bounded state instead of by the store."""
    path = fresh_path(spark, "distinct")
    stream = inputs.messages(inputs.stream_events(spark, sf_dir))
    distinct = consume.without_duplicates(decoded_events(decode_messages(stream)))
    _to_parquet(spark, distinct, path)
    return _event_columns(spark.read.parquet(path))


def _to_parquet(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Run a stream to its end; its state is kept on disk."""
    writer = rows.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", fresh_path(spark, "checkpoint")).trigger(availableNow=True)
    with state_on_disk(spark):
        query = writer.start()
    query.awaitTermination()


def _identified_stream(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    requests = inputs.metered_requests(inputs.stream_events(spark, sf_dir))
    resolved = tenants.resolve_tenants(requests, inputs.projects(spark, sf_dir), settings)
    return quota.with_quota_identity(resolved, settings)


def _ledger_decisions(spark: SparkSession, sf_dir: str, settings, anchored: bool) -> DataFrame:
    decisions, ledger = fresh_path(spark, "decisions"), fresh_path(spark, "ledger")

    def judge(batch: DataFrame, batch_id: int) -> None:
        quota_batch(batch, batch_id, decisions, ledger, settings, anchored)

    identified = _identified_stream(spark, sf_dir, settings)
    consume.start(identified, judge, fresh_path(spark, "checkpoint")).awaitTermination()
    return _decisions(spark.read.parquet(decisions))


@registered("stream_quota")
def stream_quota(spark, sf_dir):
    return _ledger_decisions(spark, sf_dir, DAY_QUOTA, anchored=False)


@registered("stream_quota_anchored")
def stream_quota_anchored(spark, sf_dir):
    """Windows that open at a first request, carried over from one micro-batch to the next."""
    return _ledger_decisions(spark, sf_dir, ANCHORED_QUOTA, anchored=True)


@registered("stream_quota_state")
def stream_quota_state(spark, sf_dir):
    """The decisions of `stream_quota` by keyed operator state instead of a ledger."""
    path = fresh_path(spark, "decisions")
    _to_parquet(spark, metered_stream(_identified_stream(spark, sf_dir, DAY_QUOTA), DAY_QUOTA), path)
    return _decisions(spark.read.parquet(path))


@registered("stream_health")
def stream_health(spark, sf_dir):
    reports = health.reported(spark, _consumed(spark, sf_dir).health)
    return reports.select("batch_id", "messages", "empty_messages")


@registered("stream_lag")
def stream_lag(spark, sf_dir):
    """The last part of the log comes after the consumer has stopped; dead letters are those of the others."""
    log, letters = fresh_path(spark, "log"), fresh_path(spark, "dead-letters")
    checkpoint = fresh_path(spark, "checkpoint")
    given = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = inputs.stream_part(F.col("ts").cast("timestamp"))
    given.where(part < 3).write.parquet(f"{log}/part=0")
    files = spark.readStream.schema(given.schema).parquet(f"{log}/*")
    files = inputs.with_mapping(inputs.spread_stream(files, given.where(part < 3).count()))
    consume.consume(inputs.messages(files), fresh_path(spark, "consumed"), letters, checkpoint).awaitTermination()
    given.where(part == 3).write.parquet(f"{log}/part=1")
    lag = health.unread(spark.read.schema(given.schema).parquet(f"{log}/*"), checkpoint)
    return lag.crossJoin(metrics.dead_letter_size(store.read_dead_letters(spark, letters)))  # one row each


def _known_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.projects(spark, sf_dir).where(F.col("name").rlike(r"^NATION_([0-9]|1[0-9]|2[0-2])$"))


@registered("stream_orphans")
def stream_orphans(spark, sf_dir):
    """Dead letters of a run in which the projects of some events are unknown."""
    run = _Consumed(spark, sf_dir, _known_projects(spark, sf_dir))
    return store.read_dead_letters(spark, run.letters).select("original_msg_id", "error", "error_type")


@registered("metrics_failures")
def metrics_failures(spark, sf_dir):
    """Dead letters by type, with a micro-batch that failed as a whole before it was replayed."""
    stream, failures = inputs.messages(inputs.stream_events(spark, sf_dir)), fresh_path(spark, "failures")
    events, letters, checkpoint = (fresh_path(spark, x) for x in ("consumed", "dead-letters", "checkpoint"))
    listener = health.HealthLog(spark, fresh_path(spark, "health"), failures)
    spark.streams.addListener(listener)

    def lost(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 2:
            raise RuntimeError("lost")
        consume.store_batch(batch, batch_id, events, letters)

    def kept(batch: DataFrame, batch_id: int) -> None:
        consume.store_batch(batch, batch_id, events, letters)

    try:
        try:
            consume.start(stream, lost, checkpoint).awaitTermination()
        except StreamingQueryException:
            pass  # as a worker that is lost and started again
        consume.start(stream, kept, checkpoint).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    return metrics.errors_by_type(store.read_dead_letters(spark, letters), spark.read.schema(health.FAILURE).parquet(failures))


# --- metrics ------------------------------------------------------------------


@registered("metrics_processed")
def metrics_processed(spark, sf_dir):
    return metrics.processed_total(store.read_events(spark, _consumed(spark, sf_dir).events))


@registered("metrics_errors")
def metrics_errors(spark, sf_dir):
    return metrics.errors_by_type(store.read_dead_letters(spark, _consumed(spark, sf_dir).letters))


@registered("metrics_dlq")
def metrics_dlq(spark, sf_dir):
    return metrics.dead_letter_size(store.read_dead_letters(spark, _consumed(spark, sf_dir).letters))


@registered("metrics_lag")
def metrics_lag(spark, sf_dir):
    """Three tenths of the log are still unread."""
    number = F.col("event_id")
    log = events_table(spark, sf_dir).select((number % 10).alias("source"), F.floor(number / 10).alias("offset"))
    return metrics.lag_by_marks(log, log.where(F.col("source") < 7))


@registered("latency_histogram")
def latency_histogram(spark, sf_dir):
    histogram = metrics.histogram_le(events_table(spark, sf_dir), F.col("value") / 100)
    return histogram.select("le", "n", "count", F.round("sum", 4).alias("sum"))


@registered("throughput")
def throughput(spark, sf_dir):
    """Even users send singly, odd ones their day in batches."""
    mapped = events_table(spark, sf_dir)
    alone = mapped.where(F.col("user_id") % 2 == 0).select("ts", F.lit(1).alias("events"))
    together = (
        mapped.where(F.col("user_id") % 2 == 1)
        .groupBy("batch")
        .agg(F.max("ts").alias("ts"), F.count("*").alias("events"))
        .select("ts", "events")
    )
    rate = metrics.delivered_throughput(alone.unionByName(together), F.col("ts"), F.col("events"))
    return rate.withColumn("second", _text(F.col("second")))


@registered("steady_state_rate")
def steady_state_rate(spark, sf_dir):
    """Events seen by the end of each day; the first day is the warm-up."""
    daily = events_table(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("at")).agg(
        (F.max("event_id") + 1).alias("total"), F.avg("value").alias("latency")
    )
    rate = metrics.steady_state_rate(daily, warm_up_seconds=43_200)
    return rate.select(
        F.round("average_rate", 6).alias("average_rate"), F.round("average_latency", 6).alias("average_latency")
    )


# --- analytics ----------------------------------------------------------------


@registered("funnel")
def funnel(spark, sf_dir):
    steps = analytics.funnel(stored_events(spark, sf_dir))
    return steps.withColumns(
        {"step": F.col("step").cast("long"), "step_rate": F.round(F.coalesce("step_rate", F.lit(0.0)), 9)}
    )


@registered("session_summary")
def session_summary(spark, sf_dir):
    summary = analytics.session_summary(stored_events(spark, sf_dir))
    return summary.withColumns(
        {"started_at": _text(F.col("started_at")), "ended_at": _text(F.col("ended_at"))}
    )


@registered("cart_state")
def cart_state(spark, sf_dir):
    return analytics.cart_state(stored_events(spark, sf_dir))


@registered("abandoned_carts")
def abandoned_carts(spark, sf_dir):
    return analytics.abandoned_carts(analytics.cart_state(stored_events(spark, sf_dir)))


@registered("revenue")
def revenue(spark, sf_dir):
    return analytics.revenue(stored_events(spark, sf_dir))


@registered("event_mix")
def event_mix(spark, sf_dir):
    return analytics.event_mix(stored_events(spark, sf_dir))
