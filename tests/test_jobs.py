"""Scheduled jobs end to end on a scratch lake built from the test tables."""

import json
import os
from datetime import datetime, timezone

from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import ingest as I
from recentlake.operators import reports as R
from recentlake.plans import jobs as J
from recentlake.sinks.writers import LakeLayout
from recentlake.sources import files as SRC
from recentlake.sources import testdata as TD

SF = "/root/testdata/sf0.001"
AS_OF = datetime(2024, 1, 1, 0, 50, tzinfo=timezone.utc)


def _doc(spark, path):
    return json.loads(spark.read.text(path).first()["value"])


def test_jobs_write_reports(spark, scratch):
    layout = LakeLayout(os.path.join(scratch, "lake"))
    ev = TD.load_processed(spark, SF)
    J.publish_processed(ev.repartition(3), layout)

    J.batch_job(spark, layout)
    assert spark.read.json(os.path.join(layout.batch, "summary")).first()["total_events"] == ev.count()

    paths = J.top_pages_job(spark, layout, AS_OF)
    top = _doc(spark, paths["top_pages"])
    want = [tuple(r) for r in R.top_pages(ev).collect()]
    assert [(p["rank"], p["title"], p["wiki"], p["edit_count"]) for p in top["top_pages"]] == want
    assert top["total_events"] == ev.count() and top["generated_at"] == "2024-01-01T00:50:00+00:00"

    g = J.global_activity_job(spark, layout, AS_OF)
    by_wiki = {r["wiki"]: r["event_count"] for r in spark.read.json(g["activity_by_wiki"]).collect()}
    assert by_wiki == {r["wiki"]: r["event_count"] for r in R.activity_by_wiki(ev).collect()}
    minutes = spark.read.json(g["activity_by_minute"])
    assert minutes.agg(F.sum("event_count")).first()[0] == ev.count()
    assert _doc(spark, g["global_activity"])["files_read"] == 3

    J.user_activity_job(spark, layout, AS_OF)
    J.bot_activity_job(spark, layout, AS_OF)
    run_path, summary_path = J.anomaly_job(spark, layout, AS_OF)
    stored = SRC.load_anomalies(spark, layout.anomalies)
    assert stored.count() == _doc(spark, summary_path)["anomaly_count"] > 0

    messages = I.ingest_messages(TD.load_raw_feed(spark, SF))
    daily = J.daily_report_job(spark, layout, messages, as_of=AS_OF)
    quality = {r["item"]: r["value"] for r in spark.read.json(daily[R.QUALITY_SECTION]).collect()}
    assert quality["anomalies_detected"] == stored.count()
    overview = spark.read.json(daily[R.GLOBAL_SECTION]).collect()
    assert sum(r["item"] == "top_pages" for r in overview) == 10
    assert {r["text"] for r in overview if r["item"] == "report_date"} == {"2024-01-01"}
    assert {r["value"] for r in overview if r["item"] == "files_read"} == {3}
    assert spark.read.json(daily[R.TRAFFIC_SECTION]).where("item = 'by_wiki'").agg(F.sum("value")).first()[0] == ev.count()

    health = _doc(spark, J.healthcheck_job(spark, layout, AS_OF))
    assert health["overall_healthy"] is True and health["top_pages_present"] is True
    assert health["monitoring_present"] is False and health["anomalies_present"] is True and health["file_count"] == 3


def test_broken_lines_are_skipped_and_counted(spark, scratch):
    layout = LakeLayout(os.path.join(scratch, "lake"))
    ev = TD.load_processed(spark, SF)
    J.publish_processed(ev, layout)
    with open(os.path.join(layout.processed_batch, "late.json"), "w") as f:
        f.write('{"title": "cut\n\n[1]\nnull\n')
    paths = J.global_activity_job(spark, layout, AS_OF)
    envelope = _doc(spark, paths["global_activity"])
    assert (envelope["total_events"], envelope["skipped_lines"]) == (ev.count(), 3)
    top = _doc(spark, J.top_pages_job(spark, layout, AS_OF)["top_pages"])
    assert [p["title"] for p in top["top_pages"]] == [r["title"] for r in R.top_pages(ev).collect()]
    J.anomaly_job(spark, layout, AS_OF)
    assert SRC.load_anomalies(spark, layout.anomalies).where("reason = 'wiki_null' and page = 'unknown'").count() == \
        ev.where("title is null and (wiki is null or trim(wiki) = '')").count()


def test_rows_published_beside_a_stream_sink_are_read(spark, scratch):
    from conftest import make_events
    from recentlake.sinks import writers as W

    layout = LakeLayout(os.path.join(scratch, "lake"))
    src = os.path.join(scratch, "src")
    cols = [f.name for f in S.PROCESSED.fields]
    make_events(spark, [{"t": i} for i in range(10)]).withColumn("kafka_key", F.lit("k")).withColumn("kafka_topic", F.lit("t")) \
        .withColumn("source", F.lit("s")).withColumn("partition_key", F.lit("p")).select(*cols).write.json(src)
    stream = spark.readStream.schema(S.PROCESSED).json(src)
    W.write_processed_stream(stream, layout.processed, os.path.join(scratch, "ck"), "json",
                             trigger={"availableNow": True}).awaitTermination(120)
    J.publish_processed(make_events(spark, [{"t": 100 + i} for i in range(7)]), layout)
    assert SRC.load_events(spark, layout.event_folders).count() == 17
    assert J.healthcheck_job(spark, layout, AS_OF)


def test_partitioned_lake_prunes_days(spark, scratch):
    from conftest import make_events

    layout = LakeLayout(os.path.join(scratch, "lake"))
    rows = [{"t": d * 86400 + i} for d in range(3) for i in range(5)]
    J.publish_processed(make_events(spark, rows), layout, partition_by_date=True)
    assert sorted(os.listdir(layout.processed_batch))[-3:] == [
        "event_date=2024-01-01", "event_date=2024-01-02", "event_date=2024-01-03"]
    day = SRC.load_events(spark, layout.event_folders, partitioned=True, since="2024-01-02", until="2024-01-02")
    assert day.count() == 5
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert R.top_pages(day).first()["edit_count"] == 5
    scope = J.Scope(partitioned=True, since="2024-01-02", until="2024-01-03")
    J.batch_job(spark, layout, scope)
    assert spark.read.json(os.path.join(layout.batch, "summary")).first()["total_events"] == 10


def test_building_a_query_starts_no_job(spark):
    """But for those that write data first, which is their feature."""
    import __spark_entry__ as E

    from recentlake.plans.queries import CARRIED_QUERIES

    writes = {"load_events", "daily_report", "pipeline", *CARRIED_QUERIES}
    tracker = spark.sparkContext.statusTracker()
    for name, query in E.queries().items():
        if name in writes or name.startswith("op"):
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        query(spark, SF)
        stages = [tracker.getStageInfo(s).name for j in tracker.getJobIdsForGroup(f"build-{name}")
                  for s in tracker.getJobInfo(j).stageIds]
        # reading a table looks at one file's schema
        assert not [s for s in stages if not s.startswith("parquet at")], (name, stages)
    spark.sparkContext._jsc.clearJobGroup()
