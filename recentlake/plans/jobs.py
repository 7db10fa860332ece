"""End-to-end jobs: the scheduled reports of the studied pipeline as Spark jobs.

Each job reads the lake, runs library operators and writes its documents
with the sinks.  ``as_of`` (run time) is a parameter everywhere so a run is
reproducible.  A job that reads its input more than once cuts the lineage
first with ``checkpoint()`` into the shared folder of
``spark.checkpoint.dir`` (never a machine-local folder), so a lost executor
costs a re-read of that checkpoint, not a recomputation of the whole job.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import anomalies as A
from recentlake.operators.frames import combine_rows
from recentlake.operators import ingest as I
from recentlake.operators import monitoring as M
from recentlake.operators import reports as R
from recentlake.session import reuse
from recentlake.sinks import writers as W
from recentlake.sources import files as SRC


def _as_of(as_of: datetime | None) -> Column:
    t = as_of or datetime.now(timezone.utc)
    return F.timestamp_micros(F.lit(int(t.timestamp() * 1_000_000)))


def _run_id(as_of: datetime | None) -> str:
    t = as_of or datetime.now(timezone.utc)
    return t.strftime("%Y-%m-%dT%H-%M-%S")


@dataclass(frozen=True)
class Scope:
    """What a job reads of the lake: its format, and for a lake partitioned
    by date the days ``since``..``until``; ``max_files`` (off by default) keeps
    the last files only."""

    fmt: str = "json"
    partitioned: bool = False
    since: str | None = None
    until: str | None = None
    max_files: int | None = None


def _events(spark: SparkSession, layout: W.LakeLayout, scope: Scope) -> DataFrame:
    ev = SRC.load_events(spark, layout.event_folders, fmt=scope.fmt, max_files=scope.max_files,
                         partitioned=scope.partitioned, since=scope.since, until=scope.until)
    return R.require_non_empty(ev, "processed events")


def _skipped(spark: SparkSession, layout: W.LakeLayout, scope: Scope) -> DataFrame:
    return SRC.skipped_lines(spark, layout.event_folders, fmt=scope.fmt, partitioned=scope.partitioned,
                             since=scope.since, until=scope.until)


def batch_job(spark: SparkSession, layout: W.LakeLayout, scope: Scope = Scope()) -> dict[str, str]:
    """Batch summary (one row) and per-wiki counts (rows, in parallel) (A1, A2)."""
    ev = _events(spark, layout, scope)
    out = {"summary": os.path.join(layout.batch, "summary"), "by_wiki": os.path.join(layout.batch, "by_wiki")}
    W.write_summary(R.batch_summary(ev), out["summary"])
    R.batch_by_wiki(ev).write.mode("overwrite").json(out["by_wiki"])
    return out


def top_pages_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None,
                  scope: Scope = Scope()) -> dict[str, str]:
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    totals = R.global_activity(ev)
    docs = {
        "top_pages": combine_rows(
            W.document(R.top_pages(ev), ts, "most active pages (all event types)", "top_pages"),
            totals.select("total_events")),
        "most_created_pages": W.document(R.most_created_pages(ev), ts, "most created pages", "most_created_pages"),
        "most_deleted_pages": W.document(R.most_deleted_pages(ev), ts, "most deleted pages", "most_deleted_pages"),
    }
    return W.write_report_set(docs, layout, "top_pages")


def global_activity_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None,
                        scope: Scope = Scope()) -> dict[str, str]:
    """Minute / hour / language / wiki distributions from one grouping-sets pass.

    Each distribution is written as rows (bucket, event_count), count-desc,
    in parallel: the minute distribution grows with the lake's time span,
    so it is never folded into one document row.  The envelope (totals,
    files read, source) is a one-row document.
    """
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    dims = reuse(R.activity_dimensions(ev))  # distinct buckets only
    out = {}
    for dim, name in (("minute", "activity_by_minute"), ("hour", "activity_by_hour"),
                      ("language", "language_distribution"), ("wiki", "activity_by_wiki")):
        rows = (dims.filter(F.col("dimension") == dim)
                .select(F.col("bucket").alias(dim), "event_count", C.iso_utc(ts).alias("generated_at"))
                .orderBy(F.col("event_count").desc(), F.col(dim)))
        out[name] = layout.report("global", name)
        rows.write.mode("overwrite").json(out[name])
    out["global_activity"] = layout.report("global", "global_activity")
    envelope = combine_rows(R.global_activity(ev, layout.processed), _skipped(spark, layout, scope))
    W.write_report(W.document(envelope, ts), out["global_activity"])
    return out


def user_activity_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None,
                      scope: Scope = Scope()) -> dict[str, str]:
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    user = combine_rows(
        W.document(R.top_contributors(ev), ts, None, "top_contributors"),
        R.bots_vs_humans(ev).select(F.struct("*").alias("bots_vs_humans")),
    )
    docs = {"user_activity": user, "anonymous_vs_logged": W.document(R.anonymous_vs_logged(ev), ts)}
    return W.write_report_set(docs, layout, "users")


def bot_activity_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None,
                     scope: Scope = Scope()) -> dict[str, str]:
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    docs = {"bot_ratio": W.document(R.bot_ratio(ev), ts),
            "active_bots": W.document(R.active_bots(ev), ts, None, "active_bots")}
    return W.write_report_set(docs, layout, "bots")


def anomaly_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None,
                scope: Scope = Scope()) -> tuple[str, str]:
    """Detect anomalies over the lake and store the run (rows + summary)."""
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    found = A.detect_anomalies(ev, ts, order_cols=A.ORDER_COLS,
                               materialize=(scope.fmt == "json"))
    analysed = ev.agg(F.count(F.lit(1)).alias("events_analyzed"))
    return W.write_anomaly_run(found, analysed, layout.anomalies, _run_id(as_of), ts)


def daily_report_job(spark: SparkSession, layout: W.LakeLayout, messages: DataFrame,
                     lag: DataFrame | None = None, as_of: datetime | None = None,
                     scope: Scope = Scope()) -> dict[str, str]:
    """Daily document over the lake plus every stored anomaly run.

    ``messages`` are the routed messages (topic volumes; the errors topic
    counts the rejected feed records).  The document is written as rows, one
    folder for each section.
    """
    ev = _events(spark, layout, scope)
    ts = _as_of(as_of)
    history = SRC.load_anomalies(spark, layout.anomalies)
    files = R.global_activity(ev).select("files_read")
    rows = reuse(R.daily_report(ev, ts, history, I.topic_volumes(messages), lag, files))
    day = (as_of or datetime.now(timezone.utc)).strftime("%Y-%m-%d")
    out = {}
    for section in (R.GLOBAL_SECTION, R.QUALITY_SECTION, R.TRAFFIC_SECTION, R.SYSTEM_SECTION):
        out[section] = os.path.join(layout.reports, "daily", day, section)
        rows.filter(F.col("section") == section).write.mode("overwrite").json(out[section])
    return out


def healthcheck_job(spark: SparkSession, layout: W.LakeLayout, as_of: datetime | None = None, fmt: str = "json") -> str:
    health = M.lake_health(spark, layout.event_folders, layout.reports, layout.anomalies, fmt)
    path = os.path.join(layout.reports, "hdfs_health_report")
    W.write_report(W.document(health, _as_of(as_of)), path)
    return path


def monitoring_job(spark: SparkSession, layout: W.LakeLayout, runs: DataFrame, task_runs: DataFrame,
                   lag: DataFrame | None = None, as_of: datetime | None = None, dags: DataFrame | None = None,
                   volumes: DataFrame | None = None) -> dict[str, tuple[str, str]]:
    """Run-log summary, failure rate and total lag as one document; DAGs, topic
    volumes and lag per partition as rows.  Dated and latest copies of each."""
    ts = _as_of(as_of)
    stamp = [C.iso_utc(ts).alias("generated_at"), F.date_format(ts, "yyyy-MM-dd").alias("report_date")]
    parts = [M.run_summary(runs, task_runs, dags), M.pipeline_failure_rate(runs, dags)]
    if lag is not None:
        parts.append(lag.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("ingestion_kafka_lag")))
    docs = {"summary": combine_rows(*parts), "dags": M.run_monitoring(runs, task_runs, dags)}
    if volumes is not None:
        docs["topic_volumes"] = volumes
    if lag is not None:
        docs["lag"] = lag
    root = os.path.join(layout.reports, "monitoring")
    return {name: W.write_versioned(df.select(*stamp, "*"), os.path.join(root, name), _run_id(as_of)) for name, df in docs.items()}


def publish_processed(events: DataFrame, layout: W.LakeLayout, fmt: str = "json",
                      partition_by_date: bool = False) -> str:
    """Batch write of processed events into the lake (append), in a folder of
    its own beside the stream sink's.

    With ``partition_by_date`` rows go to ``event_date=YYYY-MM-DD`` folders,
    so day-bounded reports prune the rest of the lake.
    """
    cols = [F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in S.PROCESSED.fields]
    w = events.select(*cols, C.event_date().alias("event_date")) if partition_by_date else events.select(*cols)
    writer = w.write.mode("append").format(fmt).option("timestampFormat", S.JSON_TIME)
    if partition_by_date:
        writer = writer.partitionBy("event_date")
    writer.save(layout.processed_batch)
    return layout.processed_batch


__all__ = [n for n in dir() if n.endswith("_job")] + ["publish_processed", "C"]
