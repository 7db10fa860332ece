from datetime import datetime

from pyspark.sql import functions as F

from recentlake.operators import live as L
from recentlake.operators import monitoring as M
from recentlake.operators import reports as R

from conftest import make_events


def test_dedupe_keeps_keyless_rows(spark):
    rows = [{"kafka_partition": 0, "kafka_offset": 1, "t": 1}, {"kafka_partition": 0, "kafka_offset": 1, "t": 1},
            {"kafka_partition": None, "kafka_offset": None, "t": 2}, {"kafka_partition": None, "kafka_offset": None,
                                                                      "t": 2},
            {"kafka_partition": None, "kafka_offset": 5, "t": 3}, {"kafka_partition": None, "kafka_offset": 5, "t": 3}]
    ev = make_events(spark, rows)
    assert L.dedupe_offsets(ev).count() == 4
    first = L.dedupe_offsets(ev, order_cols=["event_id"]).orderBy("event_id").collect()
    assert [r["event_id"] for r in first] == [0, 2, 3, 4]


def test_buffer_newest_first_and_bad_times_last(spark):
    rows = [{"t": 5}, {"t": 50}, {"t": 20, "ingestion_timestamp": "garbage"}, {"t": 40}]
    buf = L.live_buffer(make_events(spark, rows), n=2).collect()
    assert sorted(r["event_id"] for r in buf) == [1, 3]
    latest = L.latest_events(make_events(spark, rows), n=4).collect()
    assert latest[-1]["ingestion_utc"] == "timestamp invalide"


def test_live_top_pages_labels(spark):
    long_title = "x" * 60
    rows = [{"title": long_title}, {"title": long_title}, {"title": None, "wiki": ""}]
    got = L.live_top_pages(make_events(spark, rows)).collect()
    assert got[0]["page"] == "x" * 49 + "… (enwiki)" and got[0]["edit_count"] == 2
    assert got[1]["page"] == "? (?)"


def test_reports_null_bot_semantics(spark):
    rows = [{"is_bot": True}, {"is_bot": False}, {"is_bot": None}]
    ev = make_events(spark, rows)
    assert tuple(R.batch_summary(ev).first()) == (3, 1, 1)   # null counted in neither
    assert tuple(R.bots_vs_humans(ev).first()) == (1, 2, 33.33)  # null counted as human


def test_top_pages_ties_by_key(spark):
    rows = [{"title": "b"}, {"title": "a"}, {"title": "c"}, {"title": "c"}]
    got = [(r["rank"], r["title"], r["edit_count"]) for r in R.top_pages(make_events(spark, rows), 2).collect()]
    assert got == [(1, "c", 2), (2, "a", 1)]


def test_offset_lag(spark):
    end = spark.createDataFrame([("t", 0, 10), ("t", 1, 5), ("u", 0, 3)], "topic string, partition int, end_offset long")
    done = spark.createDataFrame([("t", 0, 4), ("t", 1, 9)], "topic string, partition int, committed_offset long")
    got = {(r["topic"], r["partition"]): (r["committed_offset"], r["lag"]) for r in M.offset_lag(end, done).collect()}
    assert got == {("t", 0): (4, 6), ("t", 1): (9, 0), ("u", 0): (0, 3)}
    tot = {r["topic"]: r["total_lag"] for r in M.lag_by_topic(M.offset_lag(end, done)).collect()}
    assert tot == {"t": 6, "u": 3}


def test_run_monitoring(spark):
    runs = spark.createDataFrame([
        ("a", "r1", "success", datetime(2024, 1, 1), False), ("a", "r2", "failed", datetime(2024, 1, 2), False),
        ("b", "r3", "success", datetime(2024, 1, 1), True)], "dag_id string, run_id string, state string, "
        "start_date timestamp, is_paused boolean")
    tasks = spark.createDataFrame([
        ("a", "r2", "t1", "failed", 2.0, 1), ("a", "r2", "t2", "success", 4.0, 1), ("a", "r1", "t1", "success", 100.0, 1)],
        "dag_id string, run_id string, task_id string, state string, duration_sec double, try_number int")
    per = {r["dag_id"]: (r["last_run_state"], r["failure_rate_pct"]) for r in M.run_monitoring(runs, tasks).collect()}
    assert per == {"a": ("failed", 50.0), "b": ("success", 0.0)}
    s = M.run_summary(runs, tasks).first()
    assert (s["total_dags"], s["failed_runs"], s["success_runs"], s["total_task_failures"],
            s["avg_task_duration_sec"]) == (2, 1, 1, 1, 3.0)
    assert M.pipeline_failure_rate(runs).first()[0] == 50.0


def test_lake_inventory(spark, scratch):
    import os
    ev = make_events(spark, [{"t": 1}, {"t": 2}])
    ev.coalesce(1).write.json(os.path.join(scratch, "processed", "batch=1"))
    counts, first = M.zone_inventory(spark, os.path.join(scratch, "processed"))
    assert counts.first()["file_count"] == 1
    assert first.count() == 1
    os.makedirs(os.path.join(scratch, "reports", "users"))
    health = M.lake_health(spark, [os.path.join(scratch, "processed")], os.path.join(scratch, "reports")).first()
    assert health["overall_healthy"] is True and health["top_pages_present"] is False and health["users_present"] is True
    ev.write.parquet(os.path.join(scratch, "columnar"))
    health = M.lake_health(spark, [os.path.join(scratch, "columnar"), os.path.join(scratch, "none")], scratch, fmt="parquet").first()
    assert health["overall_healthy"] is True and health["file_count"] >= 1


def test_report_coverage(spark):
    reports = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "name string, loaded boolean")
    assert tuple(M.report_coverage(reports).first()) == (2, 3)


def test_known_dags_without_runs(spark):
    runs = spark.createDataFrame([("a", "r1", "failed", datetime(2024, 1, 1), False)],
                                 "dag_id string, run_id string, state string, start_date timestamp, is_paused boolean")
    tasks = spark.createDataFrame([], "dag_id string, run_id string, state string, duration_sec double")
    dags = spark.createDataFrame([("a",), ("b",), ("c",)], "dag_id string")
    assert M.run_monitoring(runs, tasks, dags).count() == 3
    assert M.pipeline_failure_rate(runs, dags).first()[0] == 33.33
    assert M.run_summary(runs, tasks, dags).first()["total_dags"] == 3


def test_monitoring_job_versioned(spark, scratch):
    import json
    import os
    from datetime import timezone

    from recentlake.plans import jobs as J
    from recentlake.sinks.writers import LakeLayout

    runs = spark.createDataFrame([("a", "r1", "failed", datetime(2024, 1, 1), False)],
                                 "dag_id string, run_id string, state string, start_date timestamp, is_paused boolean")
    tasks = spark.createDataFrame([("a", "r1", "t", "failed", 1.5, 1)],
                                  "dag_id string, run_id string, task_id string, state string, duration_sec double, "
                                  "try_number int")
    layout = LakeLayout(os.path.join(scratch, "lake"))
    lag = spark.createDataFrame([("t", 0, 10, 4, 6)], "topic string, partition int, end_offset long, committed_offset long, lag long")
    written = J.monitoring_job(spark, layout, runs, tasks, lag, datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert spark.read.json(written["dags"][1]).first()["last_run_state"] == "failed"
    assert spark.read.json(written["lag"][0]).first()["lag"] == 6
    run_path, latest = written["summary"]
    a = json.loads(spark.read.text(run_path).first()[0])
    b = json.loads(spark.read.text(latest).first()[0])
    assert a == b and a["dag_failure_rate_pct"] == 100.0 and a["total_task_failures"] == 1


def test_live_bot_share(spark):
    rows = [{"is_bot": True}, {"is_bot": None}, {"is_bot": False}, {"is_bot": False}]
    assert tuple(L.live_bot_share(make_events(spark, rows)).first()) == (1, 3, 25.0)
