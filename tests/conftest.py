from __future__ import annotations

import os
import sys
import tempfile
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from recentlake.session import checkpoint_root, ensure_session_conf  # noqa: E402

T0 = datetime(2024, 1, 1, 0, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("recentlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_session_conf(s)
    checkpoint_root(s)
    yield s


@pytest.fixture()
def scratch():
    """A fresh folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="recentlake-test-", dir="/tmp")


EVENT_SCHEMA = (
    "event_id long, kafka_partition int, kafka_offset long, title string, wiki string, user string, "
    "is_bot boolean, is_anonymous boolean, event_type string, ingestion_timestamp string, page_id string, "
    "event_time timestamp, kafka_timestamp timestamp"
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def make_events(spark, rows: list[dict]):
    """Processed events from dicts; unspecified fields get neutral values."""
    out = []
    for i, r in enumerate(rows):
        t = r.get("t", 0)
        ts = at(t) if t is not None else None
        out.append((
            r.get("event_id", i), r.get("kafka_partition", 0), r.get("kafka_offset", i),
            r.get("title", "Page"), r.get("wiki", "enwiki"), r.get("user", "alice"),
            r.get("is_bot", False), r.get("is_anonymous", False), r.get("event_type", "edit"),
            r.get("ingestion_timestamp", ts.isoformat() if ts else None), r.get("page_id", "1"),
            ts, ts,
        ))
    return spark.createDataFrame(out, EVENT_SCHEMA)
