import json
import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom import Settings, configure  # noqa: E402
from eventloom.model import PROJECT, REQUEST  # noqa: E402

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SETTINGS = Settings(environment="test")
KNOWN = "00000000-0000-7000-8000-000000000001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


@pytest.fixture
def projects(spark):
    rows = [
        (KNOWN, "one", "free", "wk_test_1", NOW),
        (KNOWN[:-1] + "2", "two", "pro", "wk_test_2", NOW),
        (KNOWN[:-1] + "3", "three", "enterprise", "wk_test_3", NOW),
    ]
    return spark.createDataFrame(rows, PROJECT)


def raw_event(**changes):
    """A valid page view; a field set to `...` is left out."""
    event = {"event_type": "page_view", "timestamp": NOW.isoformat(), "properties": {}}
    event.update(changes)
    return {name: value for name, value in event.items() if value is not ...}


def request(request_id, body, kind="single", api_key="wk_test_1", at=NOW, ip="1.2.3.4", forwarded=None):
    text = body if body is None or isinstance(body, str) else json.dumps(body)
    return (request_id, kind, api_key, forwarded, ip, at, text)


def requests_of(spark, rows):
    return spark.createDataFrame(rows, REQUEST)


def seconds(n):
    return timedelta(seconds=n)


def rows_of(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


def items_of(spark, bodies):
    rows = [(n, NOW, body if isinstance(body, str) else json.dumps(body)) for n, body in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "n long, received_at timestamp, body string")
    return frame.withColumn("item", F.try_parse_json("body"))
