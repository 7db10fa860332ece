"""Sinks (K1-K11): lake, reports, versioned runs, Kafka-shaped rows.

Large outputs are always written in parallel (one file per task); only
one-row or top-N report documents are written as a single file.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import ingest as I
from recentlake.operators.frames import combine_rows
from recentlake.sinks.published import Published


@dataclass(frozen=True)
class LakeLayout:
    """Zone layout of the lake."""

    root: str

    @property
    def processed(self) -> str:
        return os.path.join(self.root, "processed")

    @property
    def processed_batch(self) -> str:
        """Batch writes: a folder of their own, because a stream sink's
        metadata log hides files that it did not write itself."""
        return os.path.join(self.root, "processed_batch")

    @property
    def event_folders(self) -> tuple[str, str]:
        """All folders with processed events, one for each writer."""
        return self.processed, self.processed_batch

    @property
    def checkpoints(self) -> str:
        return os.path.join(self.root, "checkpoints")

    @property
    def anomalies(self) -> str:
        return os.path.join(self.root, "anomalies")

    @property
    def batch(self) -> str:
        return os.path.join(self.root, "batch")

    @property
    def reports(self) -> str:
        return os.path.join(self.root, "reports")

    def report(self, section: str, name: str) -> str:
        return os.path.join(self.reports, section, name)


def to_kafka_rows(records: DataFrame, topic: str | None = None, key_col: str = "partition_key",
                  exclude: tuple[str, ...] = ()) -> DataFrame:
    """Records -> (topic, key, value) with the record serialised as JSON."""
    fields = [c for c in records.columns if c not in exclude and c != "topic"]
    t = F.lit(topic) if topic else F.col("topic")
    return records.select(t.alias("topic"), F.col(key_col).cast("string").alias("key"),
                          F.to_json(F.struct(*fields)).alias("value"))


def write_kafka(messages: DataFrame, bootstrap: str, checkpoint: str | None = None):
    """Write (topic, key, value) rows to Kafka, batch or streaming (K5)."""
    if messages.isStreaming:
        return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
                .option("checkpointLocation", checkpoint).start())
    messages.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).save()
    return None


def write_processed_stream(events: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                           query_name: str = "processed_sink", trigger: dict | None = None,
                           partition_by: tuple[str, ...] = ()):
    """Append a streaming frame to the lake, checkpointed (K1).

    Parquet by default (JSON lines with ``fmt='json'``); partition by a date
    column for partition pruning on read.  The sink's metadata log makes
    readers see committed micro-batches only.
    """
    w = (events.writeStream.outputMode("append").format(fmt).option("path", path).option("timestampFormat", S.JSON_TIME)
         .option("checkpointLocation", checkpoint).queryName(query_name))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def write_console(events: DataFrame, query_name: str = "console_debug", truncate: bool = False):
    """Debug sink (K2): append to stdout, no checkpoint."""
    return (events.writeStream.outputMode("append").format("console").option("truncate", truncate)
            .queryName(query_name).start())


def write_summary(df: DataFrame, path: str) -> None:
    """One-row or top-N aggregate as one JSON file, overwritten (K7)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def document(df: DataFrame, generated_at: Column, description: str | None = None,
             list_name: str | None = None) -> DataFrame:
    """One JSON document row: envelope + either the single row's fields or,
    with ``list_name``, all rows nested as an array (top-N reports only)."""
    env = [C.iso_utc(generated_at).alias("generated_at")]
    if description:
        env.append(F.lit(description).alias("description"))
    if list_name:
        cols = [F.col(c) for c in df.columns]
        body = df.agg(F.collect_list(F.struct(*cols)).alias(list_name))
        return body.select(*env, list_name)
    return df.select(*env, "*")


def write_report(doc: DataFrame, path: str) -> None:
    """Write a one-row document as one JSON file into the folder ``path``
    (``part-*.json``), overwriting (K8)."""
    doc.coalesce(1).write.mode("overwrite").json(path)


def write_versioned(df: DataFrame, root: str, run_id: str) -> tuple[str, str]:
    """A run's rows, published as the latest (K9); the folder of the run and of
    the latest rows, which for a replayed run is that of the newest one.

    Readers find the latest folder by the manifest (``latest``), which is
    swapped at once: a run that dies leaves the one before readable, and a run
    id that was published adds nothing."""
    spark, store = df.sparkSession, Published(root, "json")
    store.publish({"rows": df}, run_id, replace=True)
    now = store.paths(spark, "rows")[-1]
    return now, now


def latest(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The latest published rows under ``root`` (empty when there are none)."""
    return Published(root, "json").read(spark, "rows", schema)


def write_anomaly_run(anomalies: DataFrame, events_analyzed: DataFrame, root: str, run_id: str,
                      generated_at: Column) -> tuple[str, str]:
    """Anomaly run: rows as JSON lines under ``run=<id>`` (parallel write)
    and a one-row summary (counts) next to them.

    The run is written once and re-read for the summary, so the rule job
    does not run twice.
    """
    run_path = os.path.join(root, f"run={run_id}")
    anomalies.select(*S.ANOMALY_COLUMNS).write.mode("overwrite").json(run_path)
    spark = anomalies.sparkSession
    stored = spark.read.schema(S.ANOMALY).json(run_path)
    summary = combine_rows(events_analyzed, stored.agg(F.count(F.lit(1)).alias("anomaly_count"))).select(
        C.iso_utc(generated_at).alias("generated_at"), "events_analyzed", "anomaly_count")
    # '_'-prefixed folders are hidden from readers of ``root``
    summary_path = os.path.join(root, "_summary", f"run={run_id}")
    write_report(summary, summary_path)
    return run_path, summary_path


def write_report_set(reports: dict[str, DataFrame], layout: LakeLayout, section: str) -> dict[str, str]:
    """Several small report documents of one folder, all or nothing (K10): they
    replace the set before at once.  Returns the path of each."""
    store = Published(os.path.join(layout.reports, section), "json")
    store.publish({name: doc.coalesce(1) for name, doc in reports.items()}, uuid.uuid4().hex, replace=True)
    spark = next(iter(reports.values())).sparkSession
    return {name: store.paths(spark, name)[-1] for name in reports}


def write_messages(raw: DataFrame, root: str, batch_id: str | int, ingestion_ts: Column | None = None,
                   source: str = S.DEFAULT_SOURCE, max_events: int | None = None, fmt: str = "parquet") -> dict[str, int] | None:
    """Ingest ``raw`` lines as one published batch of messages and return the
    run's ``total``, ``valid`` and ``invalid`` lines (F2, K6, S16).

    The counts are observed while the rows go by: the input is read and parsed
    once, for the write.  ``max_events`` bounds the run, as the scheduled one.
    None for a batch that is committed already."""
    lines = raw if max_events is None else raw.limit(max_events)
    seen = Observation(f"ingest-{batch_id}")
    messages = I.ingest_messages(I.observed(I.validate_events(lines), seen), ingestion_ts, source)
    if not Published(root, fmt).publish({"messages": messages}, batch_id):
        return None
    return {k: int(v or 0) for k, v in seen.get.items()}
