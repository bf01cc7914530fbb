from datetime import timedelta

import pytest
from conftest import NOW, SETTINGS, items_of, raw_event
from pyspark.sql import functions as F

from eventloom.operators.validate import check_events


def judge(spark, bodies):
    checked = check_events(items_of(spark, bodies), SETTINGS).orderBy("n").collect()
    return [([(e.loc, e.type) for e in row.errors], row.event) for row in checked]


def of_property(name, *cases):
    return [(raw_event(properties={name: value}), expected) for value, expected in cases]


P = "properties."
RULES = [
    # required fields
    (raw_event(event_type=...), [("event_type", "missing")]),
    (raw_event(timestamp=...), [("timestamp", "missing")]),
    (raw_event(properties=...), [("properties", "missing")]),
    ({}, [("event_type", "missing"), ("timestamp", "missing"), ("properties", "missing")]),
    (raw_event(event_type=None), [("event_type", "enum")]),
    (raw_event(timestamp=None), [("timestamp", "datetime_type")]),
    (raw_event(properties=None), [("properties", "model_attributes_type")]),
    (raw_event(properties=[]), [("properties", "model_attributes_type")]),
    ([], [("", "model_attributes_type")]),
    (5, [("", "model_attributes_type")]),
    (raw_event(unknown=1), []),
    # enum
    (raw_event(event_type="click"), [("event_type", "enum")]),
    (raw_event(event_type="PAGE_VIEW"), [("event_type", "enum")]),
    (raw_event(event_type=5), [("event_type", "enum")]),
    # text
    (raw_event(user_id=None, session_id="s"), []),
    (raw_event(user_id=5), [("user_id", "string_type")]),
    (raw_event(session_id=True), [("session_id", "string_type")]),
    # time bounds, and the bounds themselves
    (raw_event(timestamp=(NOW + timedelta(minutes=5)).isoformat()), []),
    (raw_event(timestamp=(NOW + timedelta(minutes=5, microseconds=1)).isoformat()), [("timestamp", "value_error")]),
    (raw_event(timestamp=(NOW - timedelta(days=30)).isoformat()), []),
    (raw_event(timestamp=(NOW - timedelta(days=30, microseconds=1)).isoformat()), [("timestamp", "value_error")]),
    # time forms
    (raw_event(timestamp="2024-01-30"), []),
    (raw_event(timestamp="2024-01-30 10:00"), []),
    (raw_event(timestamp="2024-01-30t10:00:00.123456789z"), []),
    (raw_event(timestamp="2024-01-30T10:00:00,5+0230"), []),
    (raw_event(timestamp=1706600000), []),
    (raw_event(timestamp=1706600000123), []),
    (raw_event(timestamp="1706600000.25"), []),
    (raw_event(timestamp="20240130T100000"), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp=" 2024-01-30T10:00:00Z"), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp="2024-02-30"), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp="2024-01-30T24:00:00"), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp="2024-01-30T10:00:00+24:00"), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp=""), [("timestamp", "datetime_from_date_parsing")]),
    (raw_event(timestamp=True), [("timestamp", "datetime_type")]),
    (raw_event(timestamp=1e20), [("timestamp", "datetime_parsing")]),
    # text bounds count characters
    *of_property("product_id", ("", [(P + "product_id", "string_too_short")]), ("é" * 100, []),
                 ("é" * 101, [(P + "product_id", "string_too_long")])),
    *of_property("product_name", ("", []), ("x" * 500, []), ("x" * 501, [(P + "product_name", "string_too_long")])),
    *of_property("category", ("x" * 201, [(P + "category", "string_too_long")])),
    *of_property("browser", ("x" * 101, [(P + "browser", "string_too_long")]), (1, [(P + "browser", "string_type")])),
    *of_property("button_clicked", ("😀" * 100, []), ("😀" * 101, [(P + "button_clicked", "string_too_long")])),
    # patterns
    *of_property("currency", ("USD", []), ("usd", [(P + "currency", "string_pattern_mismatch")]),
                 ("USD\n", [(P + "currency", "string_pattern_mismatch")]), (5, [(P + "currency", "string_type")])),
    *of_property("country", ("DE", []), ("DEU", [(P + "country", "string_pattern_mismatch")])),
    *of_property("device_type", ("tablet", []), ("tv", [(P + "device_type", "string_pattern_mismatch")]),
                 ("mobile\n", [(P + "device_type", "string_pattern_mismatch")])),
    # price
    *of_property("price", (0.01, []), (1000000, []), (0, [(P + "price", "greater_than")]),
                 (-1, [(P + "price", "greater_than")]), (1000000.01, [(P + "price", "less_than_equal")]),
                 ("1e400", [(P + "price", "less_than_equal")]), ("nan", [(P + "price", "less_than_equal")]),
                 ("-inf", [(P + "price", "greater_than")]), ("0x10", [(P + "price", "float_parsing")]),
                 ("1d", [(P + "price", "float_parsing")]), ("1__0", [(P + "price", "float_parsing")]),
                 ("", [(P + "price", "float_parsing")]), ([1], [(P + "price", "float_type")]),
                 (False, [(P + "price", "greater_than")])),
    # quantity
    *of_property("quantity", (1, []), (10000, []), (0, [(P + "quantity", "greater_than_equal")]),
                 (10001, [(P + "quantity", "less_than_equal")]), (3.5, [(P + "quantity", "int_from_float")]),
                 ("3.5", [(P + "quantity", "int_parsing")]), ("3.", [(P + "quantity", "int_parsing")]),
                 ("1e2", [(P + "quantity", "int_parsing")]), ({}, [(P + "quantity", "int_type")]),
                 (10**30, [(P + "quantity", "less_than_equal")]), (1e300, [(P + "quantity", "int_parsing_size")]), ("99999999999999999999", [(P + "quantity", "less_than_equal")])),
    # address
    *of_property("page_url", ("https://a.com/x", []), ("a.com", [(P + "page_url", "url_parsing")]),
                 ("ftp://a.com", [(P + "page_url", "url_scheme")]), ("", [(P + "page_url", "url_parsing")]),
                 (5, [(P + "page_url", "url_type")]),
                 ("https://a.com/" + "x" * 2070, [(P + "page_url", "url_too_long")])),
    # what each type needs
    (raw_event(event_type="purchase"), [("", "value_error")]),
    (raw_event(event_type="purchase", properties={"product_id": "p", "price": 1, "quantity": 1}), []),
    (raw_event(event_type="add_to_cart", properties={"price": 10.0}), [("", "value_error")]),
    (raw_event(event_type="remove_from_cart", properties={"product_id": "p"}), []),
    (raw_event(event_type="product_view"), [("", "value_error")]),
    # several field errors, and then no cross-field check
    (raw_event(event_type="purchase", properties={"price": -1, "currency": "x"}),
     [(P + "price", "greater_than"), (P + "currency", "string_pattern_mismatch")]),
]


def test_every_rule(spark):
    judged = judge(spark, [body for body, _ in RULES])
    wrong = [
        (body, expected, found)
        for (body, expected), (found, _) in zip(RULES, judged)
        if found != expected
    ]
    assert wrong == []


def test_lenient_readings(spark):
    prices = [(12.50, 1250), (10.99, 1099), (99.90, 9990), (" 7 ", 700), ("1_000", 100000), (True, 100), (".5", 50),
              ("5.", 500), ("+5", 500), ("1e3", 100000), (1.005, 100), (0.125, 12), (0.375, 38)]
    quantities = [("3", 3), ("3.0", 3), (3.0, 3), (True, 1), (" 3 ", 3), ("1_000", 1000), ("0003", 3), (1e3, 1000)]
    bodies = [raw_event(properties={"price": given}) for given, _ in prices]
    bodies += [raw_event(properties={"quantity": given}) for given, _ in quantities]
    judged = judge(spark, bodies)
    assert [errors for errors, _ in judged if errors] == []
    found = [event.properties.price for _, event in judged[: len(prices)]]
    assert found == [expected for _, expected in prices]
    found = [event.properties.quantity for _, event in judged[len(prices) :]]
    assert found == [expected for _, expected in quantities]


@pytest.mark.parametrize(
    "properties, missing",
    [
        ({"price": 1, "quantity": 1}, "PURCHASE requires product_id"),
        ({"product_id": "p", "quantity": 1}, "PURCHASE requires price"),
        ({"product_id": "p", "price": 1}, "PURCHASE requires quantity"),
    ],
)
def test_first_missing_purchase_field_is_reported(spark, properties, missing):
    body = raw_event(event_type="purchase", properties=properties)
    row = check_events(items_of(spark, [body]), SETTINGS).first()
    assert [e.msg for e in row.errors] == [f"Value error, {missing}"]


def test_absent_properties_are_null(spark):
    (_, event), = judge(spark, [raw_event()])
    assert set(event.properties.asDict().values()) == {None}


def test_repeated_key_keeps_the_last(spark):
    text = '{"event_type":"x","event_type":"page_view","timestamp":"2024-01-31","properties":{}}'
    assert judge(spark, [text])[0][0] == []


def test_times_are_utc(spark):
    forms = ["2024-01-30T10:00:00", "2024-01-30T12:00:00+02:00", "2024-01-30T10:00:00Z", 1706608800, "1706608800000"]
    checked = check_events(items_of(spark, [raw_event(timestamp=form) for form in forms]), SETTINGS)
    found = checked.select(F.unix_seconds("event.timestamp")).distinct().collect()
    assert [row[0] for row in found] == [1706608800]


def test_no_python_in_validation(spark):
    plan = check_events(items_of(spark, [raw_event()]), SETTINGS)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan
