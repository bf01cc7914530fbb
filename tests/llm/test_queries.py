"""Every corpus query that has SQL against it, on the smallest given tables."""

import duckdb
import pytest
from eventloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def normal(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, database, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    assert normal(ours) == normal(database.execute(queries.oracle_sql()[name]).df())
