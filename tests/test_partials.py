"""Carried counts equal the full scan; only new files are opened."""

import os
import time

import pytest
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import partials as P
from recentlake.operators import reports as R
from recentlake.sinks.published import Conflict, Published
from recentlake.sources import files as SRC
from recentlake.sources import testdata as TD

SF = "/root/testdata/sf0.001"


def _write(events, folder, name):
    """Events as one JSON file ``name`` of the lake."""
    lines = [r[0] for r in events.select(F.to_json(F.struct(*(f.name for f in S.PROCESSED.fields)), {"timestampFormat": S.JSON_TIME})).collect()]
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + '\n{"title": "cut\n\n')


def _lake(spark, scratch, n=3):
    ev, root = TD.load_processed(spark, SF), os.path.join(scratch, "lake")
    for k in range(n):
        _write(ev.where(F.col("event_id") % n == k), root, f"part {k}.json")
    return ev, root


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_report_equals_the_full_scan(spark, scratch):
    ev, lake = _lake(spark, scratch)
    table = P.ReportTable(os.path.join(scratch, "counts"))
    assert [os.path.basename(p) for p in table.update(spark, [lake], "1")] == ["part 0.json", "part 1.json", "part 2.json"]
    counts = table.counts(spark).cache()
    for name, report in P.REPORTS.items():
        got = report(counts)
        want = getattr(R, name)(ev)
        assert got.columns == want.columns, name
        assert _rows(got) == _rows(want), name
    counts.unpersist()


def test_only_new_files_are_opened(spark, scratch):
    ev, lake = _lake(spark, scratch, 2)
    table = P.ReportTable(os.path.join(scratch, "counts"))
    table.update(spark, [lake], "1")
    late = ev.where("event_id % 5 = 0")
    _write(late, os.path.join(lake, "late"), "more.json")
    seen = []
    opened = SRC.open_files
    P.open_files, kept = (lambda s, paths, fmt: seen.append(list(paths)) or opened(s, paths, fmt)), P.open_files
    try:
        new = table.update(spark, [lake], "2")
    finally:
        P.open_files = kept
    assert [os.path.basename(p) for p in new] == ["more.json"] and seen == [new]
    assert _rows(P.activity_by_hour(table.counts(spark))) == _rows(R.activity_by_hour(ev.unionByName(late)))
    assert table.update(spark, [lake], "3") == [] and table.update(spark, [lake], "2") == []
    scanned = table.counts(spark).inputFiles()
    assert scanned and not [f for f in scanned if "/lake/" in f]


def test_rewritten_and_removed_files(spark, scratch):
    ev, lake = _lake(spark, scratch, 3)
    table = P.ReportTable(os.path.join(scratch, "counts"))
    table.update(spark, [lake], "1")
    time.sleep(1.1)
    _write(ev.where("event_id % 3 = 0 and event_id % 2 = 0"), lake, "part 0.json")
    os.replace(os.path.join(lake, "part 1.json"), os.path.join(scratch, "moved.json"))
    assert [os.path.basename(p) for p in table.update(spark, [lake], "2")] == ["part 0.json"]
    left = ev.where("event_id % 3 = 2 or event_id % 6 = 0")
    for name in ("activity_by_hour", "top_pages", "bot_ratio"):
        assert _rows(P.REPORTS[name](table.counts(spark))) == _rows(getattr(R, name)(left)), name
    os.replace(os.path.join(scratch, "moved.json"), os.path.join(lake, "part 1.json"))  # comes back unchanged
    table.update(spark, [lake], "3")
    back = ev.where("event_id % 3 > 0 or event_id % 6 = 0")
    assert _rows(P.bot_ratio(table.counts(spark))) == _rows(R.bot_ratio(back))
    assert table.merge(spark) and len(table.store.paths(spark, "counts")) == 1
    assert _rows(P.top_pages(table.counts(spark))) == _rows(R.top_pages(back))
    assert table.update(spark, [lake], "4") == []
    assert table.store.vacuum(spark) >= 3
    assert _rows(P.bot_ratio(table.counts(spark))) == _rows(R.bot_ratio(back))


def test_days_and_empty_lake(spark, scratch):
    from conftest import make_events

    lake = os.path.join(scratch, "lake")
    table = P.ReportTable(os.path.join(scratch, "counts"))
    assert table.update(spark, [lake], "0") == []
    assert P.bot_ratio(table.counts(spark)).first()["total_events"] == 0 and P.top_pages(table.counts(spark)).count() == 0
    ev = make_events(spark, [{"t": d * 86400 + i} for d in range(3) for i in range(4)] + [{"t": None}])
    for c in ("kafka_key", "kafka_topic", "source", "partition_key"):
        ev = ev.withColumn(c, F.lit("x"))
    _write(ev.withColumn("kafka_timestamp", F.col("event_time")), lake, "days.json")
    table.update(spark, [lake], "1")
    day = table.counts(spark, since="2024-01-02", until="2024-01-02")
    assert P.batch_summary(day).first()["total_events"] == 4
    assert P.batch_summary(table.counts(spark)).first()["total_events"] == 13


def test_published_tables(spark, scratch):
    store = Published(os.path.join(scratch, "t"))
    one, two = spark.range(3), spark.range(3, 5)
    assert store.read(spark, "a", "id long").count() == 0
    assert store.publish({"a": one, "b": two}, 1) and not store.publish({"a": two}, 1)  # a replay adds nothing
    assert store.publish({"a": two}, 2)
    assert sorted(r.id for r in store.read(spark, "a", "id long").collect()) == [0, 1, 2, 3, 4]
    held = store.read(spark, "a", "id long")
    failing = spark.range(4).select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        store.publish({"b": one, "a": failing}, 3)
    assert store.batches(spark) == ["1", "2"] and store.read(spark, "b", "id long").count() == 2
    assert store.publish({"a": one}, 3, replace=True)
    assert store.read(spark, "a", "id long").count() == 3 and store.read(spark, "b", "id long").count() == 0
    assert held.count() == 5  # a reader of the old state finishes
    assert not store.publish({"a": one}, 2)
    with pytest.raises(Conflict):
        store._commit(spark, store._newest(spark)[0], [])
