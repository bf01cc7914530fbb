import uuid

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from eventloom.functions import ids, money, text, times
from eventloom.functions.jsonmerge import merged
from eventloom.functions.urls import with_url

URLS = [
    ("https://Shop.Example.com", "https://shop.example.com/"),
    ("http://a.com:80/x", "http://a.com/x"),
    ("https://a.com:443", "https://a.com/"),
    ("https://a.com:8443/x?y=1#z", "https://a.com:8443/x?y=1#z"),
    ("http://a.com/a b", "http://a.com/a%20b"),
    ("https://a.com/../b/./c", "https://a.com/b/c"),
    ("https://a.com/%2e%2E/b", "https://a.com/b"),
    ("https://a.com/x/..", "https://a.com/"),
    ("https://a.com/a//b", "https://a.com/a//b"),
    (" https://a.com ", "https://a.com/"),
    ("https://user:pw@a.com/", "https://user:pw@a.com/"),
    ("https://:@a.com/", "https://a.com/"),
    ("https://u@a.com", "https://u@a.com/"),
    ("https://a.com/ü", "https://a.com/%C3%BC"),
    ("https://a.com?x=a b", "https://a.com/?x=a%20b"),
    ("https://a.com/a\\b", "https://a.com/a/b"),
    ("https://[::1]/", "https://[::1]/"),
    ("https://a.com:0/", "https://a.com:0/"),
    ("https://a.com:/x", "https://a.com/x"),
    ("http://a.com:080/", "http://a.com/"),
    ("https://a_b.com/", "https://a_b.com/"),
    ("https://a..com/", "https://a..com/"),
    ("https://a.com/%7e%zz", "https://a.com/%7e%zz"),
    ('https://a.com/<>"`{}|^', "https://a.com/%3C%3E%22%60%7B%7D|^"),
    ("https://a.com?q=<>\"'`{}|^", "https://a.com/?q=%3C%3E%22%27`{}|^"),
    ('https://a.com#f <>"`{}|^', "https://a.com/#f%20%3C%3E%22%60{}|^"),
    ("https:a.com", "https://a.com/"),
    ("http:///x", "http://x/"),
    ("https://a.com/a\tb\n", "https://a.com/ab"),
    ("https://a%41.com/", "https://aa.com/"),
    ("https://1.2.3.4/", "https://1.2.3.4/"),
    ("https://a.com./", "https://a.com./"),
    ("http://127.1/", "http://127.0.0.1/"),
    ("https://0x7f.1/", "https://127.0.0.1/"),
    ("http://1", "http://0.0.0.1/"),
    ("http://01.2.3.4.", "http://1.2.3.4/"),
    ("http://1.2.3.4.5", "url_parsing"),
    ("http://a.1", "url_parsing"),
    ("http://u@v@a.com", "http://u%40v@a.com/"),
    ("ftp://a b", "url_parsing"),
    ("http://localhost", "http://localhost/"),
    ("https://a.com/?", "https://a.com/?"),
    ("https://a.com/#", "https://a.com/#"),
    ("https://-a.com/", "https://-a.com/"),
    ("https://a.com/;p=1", "https://a.com/;p=1"),
    ("ftp://a.com", "url_scheme"),
    ("javascript:1", "url_scheme"),
    ("a.com", "url_parsing"),
    ("//a.com", "url_parsing"),
    ("http://", "url_parsing"),
    ("", "url_parsing"),
    ("https://a.com:99999/", "url_parsing"),
    ("https://a b.com/", "url_parsing"),
    ("https://256.1.1.1/", "url_parsing"),
    ("https://exa<mple.com", "url_parsing"),
]


def test_urls(spark):
    given = spark.createDataFrame(URLS, "address string, expected string")
    found = with_url(given, "address", "url").select(
        "address", "expected", F.coalesce("url_problem", "url").alias("found")
    )
    assert [tuple(row) for row in found.where("found is distinct from expected").collect()] == []


def test_price_rounds_half_to_even(spark):
    prices = [0.125, 0.375, 10.99, 1.005, 12.5, 2.675, 0.01, 1e6]
    given = spark.createDataFrame([(p,) for p in prices], "p double")
    found = [row[0] for row in given.select(money.minor_units(F.col("p"))).collect()]
    assert found == [round(p * 100) for p in prices]


def test_strip_removes_any_white_space(spark):
    names = ["  a b ", "\t\na\n", " a ", "   ", "a"]
    given = spark.createDataFrame([(name,) for name in names], "s string")
    assert [row[0] for row in given.select(text.strip(F.col("s"))).collect()] == [n.strip() for n in names]


def test_code_to_words(spark):
    given = spark.createDataFrame([("NotFoundError",), ("RateLimitExceededError",)], "c string")
    assert [row[0] for row in given.select(text.words_of(F.col("c"))).collect()] == [
        ["not", "found", "error"],
        ["rate", "limit", "exceeded", "error"],
    ]
    assert given.select(text.title_of(F.col("c"))).first()[0] == "Not Found Error"


def test_event_keys(spark):
    rows = [(NOW, "r", n) for n in range(500)] + [(NOW, "s", 0)]
    frame = spark.createDataFrame(rows, "at timestamp, r string, n long")
    keyed = frame.select("r", "n", ids.event_key(F.col("at"), F.col("r"), F.col("n")).alias("k"))
    first, again = keyed.collect(), keyed.collect()
    assert first == again and len({row.k for row in first}) == len(rows)
    parsed = [uuid.UUID(row.k) for row in first]
    assert {u.version for u in parsed} == {7} and {u.variant for u in parsed} == {uuid.RFC_4122}
    assert {u.int >> 80 for u in parsed} == {int(NOW.timestamp() * 1000)}
    in_order = [row.k for row in sorted(first, key=lambda row: row.n) if row.r == "r"]
    assert in_order == sorted(in_order)


def test_uuid_spellings(spark):
    plain = "018d5cd0-bc00-7000-929f-03f573aed180"
    forms = [plain, plain.upper(), plain.replace("-", ""), f"{{{plain}}}", f"urn:uuid:{plain}", "x", plain[:-1]]
    given = spark.createDataFrame([(form,) for form in forms], "s string")
    found = [row[0] for row in given.select(ids.canonical_uuid(F.col("s"))).collect()]
    assert found == [plain] * 5 + [None] * 2


@pytest.mark.parametrize(
    "form, seconds",
    [
        ("2024-01-01T00:00:00+00:00", 0),
        ("2024-01-01", 0),
        ("20240101T000000", 0),
        ("2024-01-01T02:00:00+02:00", 0),
        ("2024-01-01T02+02", 0),
        ("2024-01-01 00:00:00.500000", 0.5),
        ("2024-01-01T00:00:00,25Z", 0.25),
        ("nonsense", None),
        ("2024-13-01", None),
    ],
)
def test_wire_times(spark, form, seconds):
    given = spark.createDataFrame([(form,)], "s string")
    micros = given.select(F.unix_micros(times.parse_wire_time(F.col("s")))).first()[0]
    assert micros == (None if seconds is None else 1704067200_000000 + int(seconds * 1e6))


def test_iso_text_round_trips(spark):
    given = spark.createDataFrame([("2024-01-01T00:00:00+00:00",), ("2024-01-01T00:00:00.000500+00:00",)], "s string")
    assert given.where(times.iso_text(times.parse_wire_time(F.col("s"))) != F.col("s")).count() == 0


@pytest.mark.parametrize(
    "base, person, device, expected",
    [
        ('{"a":1}', None, None, '{"a":1}'),
        (None, '{"a":1}', None, None),
        ('{"a":1,"b":2}', '{"b":{"x":[1]}}', '{"c":null}', '{"a":1,"b":{"x":[1]},"c":null}'),
        ('{"a":1}', '{"a":null}', None, '{"a":null}'),
        ('{"a":1}', '{"a":2}', '{"a":3}', '{"a":3}'),
    ],
)
def test_merge(spark, base, person, device, expected):
    given = spark.createDataFrame([(base, person, device)], "a string, b string, c string")
    assert given.select(merged(F.col("a"), F.col("b"), F.col("c"))).first()[0] == expected
