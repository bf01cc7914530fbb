"""Every registered query against its SQL, on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom.registry import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = ["events", "nation"]


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normal(frame):
    columns = sorted(frame.columns)
    rows = sorted(tuple(str(v) for v in row) for row in frame[columns].itertuples(index=False))
    return columns, rows


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, database, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = database.execute(entry.oracle_sql()[name]).df()
    assert normal(ours) == normal(theirs)


def test_accepted_counts(spark):
    """Counts stated in FIXTURES.md."""
    counts = entry.entry(spark).groupBy("event_type").sum("events").collect()
    assert {row[0]: row[1] for row in counts} == {
        "page_view": 196,
        "product_view": 192,
        "add_to_cart": 107,
        "remove_from_cart": 27,
        "purchase": 123,
    }
