"""All-or-nothing sinks, observed counts, compaction, listeners, top counts."""

import json
import os
import time

import pytest
from conftest import make_events
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import anomalies as A
from recentlake.operators import ingest as I
from recentlake.operators import ranking as K
from recentlake.operators import reports as R
from recentlake.sinks import writers as W
from recentlake.sinks.compaction import CompactedLake
from recentlake.sinks.published import Published
from recentlake.sources import files as SRC
from recentlake.sources import testdata as TD
from recentlake.streaming import etl as ETL

SF = "/root/testdata/sf0.001"


def _failing(spark):
    return spark.range(5).select(F.raise_error(F.lit("killed")).cast("long").alias("id"))


def test_a_dead_run_leaves_the_latest_readable(spark, scratch):
    root = os.path.join(scratch, "runs")
    assert W.latest(spark, root, "id long").count() == 0
    run, latest = W.write_versioned(spark.range(3), root, "r1")
    assert run == latest and spark.read.json(run).count() == 3
    with pytest.raises(Exception, match="killed"):
        W.write_versioned(_failing(spark), root, "r2")
    assert W.latest(spark, root, "id long").count() == 3
    W.write_versioned(spark.range(7), root, "r2")
    W.write_versioned(spark.range(9), root, "r2")  # a replayed run adds nothing
    assert W.latest(spark, root, "id long").count() == 7 and spark.read.json(run).count() == 3


def test_report_sets_are_all_or_nothing(spark, scratch):
    layout = W.LakeLayout(scratch)
    old = W.write_report_set({"a": spark.range(1), "b": spark.range(2)}, layout, "users")
    with pytest.raises(Exception, match="killed"):
        W.write_report_set({"a": spark.range(5), "b": _failing(spark)}, layout, "users")
    store = Published(os.path.join(layout.reports, "users"), "json")
    assert [store.read(spark, n, "id long").count() for n in "ab"] == [1, 2]
    new = W.write_report_set({"a": spark.range(3)}, layout, "users")
    assert store.read(spark, "a", "id long").count() == 3 and store.read(spark, "b", "id long").count() == 0
    assert spark.read.json(old["b"]).count() == 2 and spark.read.json(new["a"]).count() == 3


def test_counts_come_from_the_write(spark, scratch):
    src = os.path.join(scratch, "raw")
    TD.load_raw_feed(spark, SF).select("value").repartition(3).write.text(src)
    raw = SRC.read_raw_events(spark, src)
    want = I.validation_counts(I.validate_events(raw)).first().asDict()
    spark.sparkContext.setJobGroup("ingest-once", "")
    got = W.write_messages(raw, os.path.join(scratch, "out"), "b1")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("ingest-once") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext._jsc.clearJobGroup()
    assert got == want and got["invalid"] > 0
    assert len(stages) == 1  # one scan: the write
    assert W.write_messages(raw, os.path.join(scratch, "out"), "b1") is None
    stored = Published(os.path.join(scratch, "out")).read(spark, "messages", "topic string, key string, value string")
    assert stored.where(F.col("topic") == S.TOPIC_ERRORS).count() == got["invalid"]
    assert W.write_messages(raw, os.path.join(scratch, "out"), "b2", max_events=40)["total"] == 40


def test_stream_counts_by_listener(spark, scratch):
    src = os.path.join(scratch, "raw")
    TD.load_raw_feed(spark, SF).select("value").repartition(3).write.text(src)
    listener = ETL.IngestCounts()
    spark.streams.addListener(listener)
    try:
        stream = SRC.read_raw_events(spark, src, streaming=True, max_files_per_trigger=1)
        messages = I.ingest_messages(I.observed(I.validate_events(stream), "ingest"))
        q = messages.writeStream.format("noop").option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = I.validation_counts(I.validate_events(SRC.read_raw_events(spark, src))).first().asDict()
        for _ in range(50):
            if listener.batches and listener.totals() == want:
                break
            time.sleep(0.2)
        assert listener.totals() == want and len(listener.batches) == 3
    finally:
        spark.streams.removeListener(listener)


def test_topics_are_counted_without_values(spark):
    raw = TD.load_raw_feed(spark, SF)
    topics = I.message_topics(raw)
    assert sorted(map(tuple, I.topic_volumes(topics).collect())) == sorted(map(tuple, I.topic_volumes(I.ingest_messages(raw)).collect()))
    records = [df._jdf.queryExecution().optimizedPlan().toString() for df in (topics, I.ingest_messages(raw))]
    assert ["partial_event" in p for p in records] == [False, True]


def test_truth_of_json_values(spark):
    values = ['true', 'false', 'null', '0', '0.0', '1', '-2.5', '""', '"false"', '"0"', '[]', '[0]', '{}', '{"a": 0}', '1e2', '9007199254740993']
    rows = [(i, json.dumps({"i": i}).replace("}", f', "bot": {v}, "anonymous": {v}, "userid": {v}}}')) for i, v in enumerate(values)]
    got = {r.i: r.event for r in I.parse_raw_events(spark.createDataFrame(rows, "i int, value string")).collect()}
    for i, v in enumerate(values):
        x = json.loads(v)
        assert bool(got[i].bot) == bool(x), v
        assert bool(got[i].anonymous) == (x is True), v
        whole = isinstance(x, (bool, int, float)) and float(x).is_integer()
        assert got[i].userid == (int(float(x)) if whole else None), v


def test_variant_payload_needs_no_json_parse(spark, scratch):
    records = I.enrich_events(I.validate_events(TD.load_raw_feed(spark, SF)), TD.as_of_col(), keep=["event_id"], variant_payload=True)
    path = os.path.join(scratch, "lake")
    records.write.parquet(path)
    rule = A.rule(spark.read.parquet(path), "missing_page_id", TD.as_of_col(), ("event_id",))
    plan = rule._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "get_json_object" not in plan and "from_json" not in plan
    assert rule.count() > 0


def test_stream_files_are_compacted_while_the_stream_goes_on(spark, scratch):
    schema = make_events(spark, [{"t": 0}]).withColumn("event_date", F.to_date("event_time")).schema
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    lake = CompactedLake(out, os.path.join(scratch, "merged"), schema, partition_by=("event_date",))
    assert lake.read(spark).count() == 0 and lake.compact(spark, "0") == 0

    def more(k):
        rows = [{"t": d * 86400 + k * 100 + i, "event_id": k * 100 + d * 10 + i} for d in range(3) for i in range(6)]
        ev = make_events(spark, rows).withColumn("event_date", F.to_date("event_time"))
        ev.repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        W.write_processed_stream(stream, out, ck, trigger={"availableNow": True}, partition_by=("event_date",)).awaitTermination(120)

    def ids(df):
        return sorted(r.event_id for r in df.collect())

    more(0)
    more(1)
    before = ids(lake.read(spark))
    assert len(before) == 36 and lake.compact(spark, "1") > 6
    assert ids(lake.read(spark)) == before and lake._files(spark) == []
    assert len(lake.store.read(spark, "rows", schema).inputFiles()) <= 6
    more(2)  # the stream writes on after the compaction
    assert len(ids(lake.read(spark))) == 54
    assert lake.compact(spark, "1") == 0 and lake.compact(spark, "2") > 0
    assert ids(lake.read(spark)) == ids(spark.read.parquet(out))
    day = lake.read(spark).where(F.col("event_date") == F.to_date(F.lit("2024-01-02")))
    assert day.count() == 18 and "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_polls_read_what_is_new(spark, scratch):
    src, ck = os.path.join(scratch, "src"), os.path.join(scratch, "ck")
    got = []
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(src)
        rows = ETL.poll_new(spark.readStream.schema("id long").parquet(src), lambda df, _: got.extend(r.id for r in df.collect()), ck, 60)
        assert rows == 10
    assert sorted(got) == list(range(30))


def test_alarm_fires_once_until_rows_come():
    clock, fired = [0.0], []
    alarm = ETL.StalenessAlarm(lambda name, age: fired.append((name, age)), 60, lambda: clock[0])
    alarm.names["q"] = "feed"
    for t, rows in ((0, 5), (50, 0), (61, 0), (90, 0), (100, 3), (150, 0), (170, 0)):
        clock[0] = t
        alarm._look("q", rows)
    assert fired == [("feed", 61.0), ("feed", 70.0)]


def test_alarm_listens_to_a_query(spark, scratch):
    fired = []
    alarm = ETL.StalenessAlarm(lambda name, age: fired.append(name), stale_seconds=-1)
    spark.streams.addListener(alarm)
    try:
        src = os.path.join(scratch, "src")
        spark.range(3).write.parquet(src)
        spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200")
        q = spark.readStream.schema("id long").parquet(src).writeStream.format("noop").queryName("quiet") \
            .option("checkpointLocation", os.path.join(scratch, "ck")).start()
        for _ in range(100):
            if fired:
                break
            time.sleep(0.2)
        q.stop()
        assert fired == ["quiet"]
    finally:
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
        spark.streams.removeListener(alarm)


def test_top_counts_shuffle_few_keys(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).otherwise(F.col("id")).alias("k"),
                                      F.lit("w").alias("wiki"))
    counts = rows.groupBy("k", "wiki").agg(F.count(F.lit(1)).alias("edit_count"))
    want = [tuple(r) for r in K.top_n(counts, 10, "edit_count", ["k", "wiki"]).collect()]
    got = K.top_counts(rows, 10, ["k", "wiki"], groups=1 << 14)
    assert sorted(tuple(r) for r in got.select(*K.top_n(counts, 10, "edit_count", ["k", "wiki"]).columns).collect()) == sorted(want)
    # few groups, flat counts, and fewer keys than asked for give the same
    flat = spark.range(3000).select(F.col("id").alias("k"), F.lit("w").alias("wiki"))
    flat_counts = flat.groupBy("k", "wiki").agg(F.count(F.lit(1)).alias("edit_count"))
    for groups, n, r, c in ((4, 10, rows, counts), (64, 10, flat, flat_counts), (1 << 14, 5000, flat, flat_counts)):
        a = K.top_counts(r, n, ["k", "wiki"], groups=groups).select("rank", "k", "wiki", "edit_count")
        b = K.top_n(c, n, "edit_count", ["k", "wiki"]).select("rank", "k", "wiki", "edit_count")
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_top_pages_of_many_shuffles_less(spark, scratch):
    from pyspark.sql import Row

    ev = TD.load_processed(spark, SF)
    assert [tuple(r) for r in R.top_pages_of_many(ev).orderBy("rank").collect()] == [tuple(r) for r in R.top_pages(ev).orderBy("rank").collect()]
    many = spark.range(200_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("hot"), F.col("id") % 30)).otherwise(
        F.concat(F.lit("page"), F.col("id"))).alias("title"), F.lit("enwiki").alias("wiki"))
    path = os.path.join(scratch, "many")
    many.write.parquet(path)
    got = R.top_pages_of_many(spark.read.parquet(path), 3)
    assert [r.edit_count for r in got.orderBy("rank").collect()] == [6667, 6667, 6666]
    rows = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in rows and isinstance(got.first(), Row)
