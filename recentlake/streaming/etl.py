"""Structured Streaming ETL: feed -> validated messages, topic -> lake.

The same operators as the batch path run on streaming frames: parsing,
validation, enrichment and routing are narrow projections, so a stream job
is a scan, a projection and an append, with exactly-once files through the
sink's checkpoint and metadata log.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from recentlake import schema as S
from recentlake.operators import ingest as I
from recentlake.sources.kafka import add_event_time, decode_kafka, json_objects


def ingest_stream(raw_lines: DataFrame, ingestion_ts: Column | None = None,
                  source: str = S.DEFAULT_SOURCE) -> DataFrame:
    """Raw feed lines (streaming) -> (topic, key, value) messages."""
    return I.ingest_messages(raw_lines, ingestion_ts, source)


def processed_stream(kafka_rows: DataFrame) -> DataFrame:
    """Kafka-shaped rows (streaming) -> processed events with event_time."""
    return add_event_time(decode_kafka(kafka_rows))


def live_stream(kafka_rows: DataFrame) -> DataFrame:
    """Kafka-shaped rows (streaming) -> events of the live views: messages
    whose value is no JSON object are not shown."""
    return processed_stream(json_objects(kafka_rows))


def messages_as_processed(messages: DataFrame, topic: str = S.TOPIC_RAW) -> DataFrame:
    """Routed messages of one topic -> processed events, without a broker.

    Offsets are unknown without Kafka, so ``kafka_partition``/``kafka_offset``
    are null; ``kafka_timestamp`` is the processing time.
    """
    rows = messages.filter(F.col("topic") == topic).select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.col("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("long").alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
    return processed_stream(rows)


def fan_out(df: DataFrame, sinks: dict[str, callable], checkpoint: str, query_name: str = "fan_out",
            trigger: dict | None = None) -> StreamingQuery:
    """One source read feeding several sinks (K3) through ``foreachBatch``.

    Each micro-batch is persisted once and handed to every sink, instead of
    running the source twice with two consumer groups.  Sinks get
    ``(batch_df, batch_id)`` and must be idempotent per batch id (overwrite a
    ``batch=<id>`` folder, or key writes on it).
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks.values():
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    w = df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).queryName(query_name)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()


def poll_new(stream: DataFrame, sink: callable, checkpoint: str, timeout_s: int | None = None) -> int:
    """One bounded run over what came since the last one (S11); returns its rows.

    Offsets are kept in ``checkpoint``: with a Kafka source of ``mode="new"``
    the first run starts at the end of the topic and each later one goes on
    where the last stopped, in batches of ``maxOffsetsPerTrigger``.  ``sink``
    gets ``(batch_df, batch_id)``.
    """
    query = fan_out(stream, {"sink": sink}, checkpoint, "poll_new", {"availableNow": True})
    query.awaitTermination(timeout_s)
    return sum(p.numInputRows for p in query.recentProgress)


class StalenessAlarm(StreamingQueryListener):
    """Calls ``alarm(name, seconds)`` when a query has had no rows for
    ``stale_seconds`` (L6), once until rows come again.

    Add it with ``spark.streams.addListener``.  Spark reports idle queries at
    ``spark.sql.streaming.noDataProgressEventInterval``, so nothing polls."""

    def __init__(self, alarm: callable, stale_seconds: float = S.STALE_SECONDS, clock: callable = time.time):
        self.alarm, self.stale_seconds, self.clock = alarm, stale_seconds, clock
        self.last: dict[str, float] = {}
        self.names: dict[str, str | None] = {}
        self.fired: set[str] = set()

    def _look(self, run: str, rows: int) -> None:
        now = self.clock()
        if rows or run not in self.last:
            self.last[run] = now
            self.fired.discard(run)
        elif now - self.last[run] > self.stale_seconds and run not in self.fired:
            self.fired.add(run)
            self.alarm(self.names.get(run), now - self.last[run])

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name
        self._look(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        self._look(str(event.progress.runId), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._look(str(event.runId), 0)

    def onQueryTerminated(self, event) -> None:
        for known in (self.last, self.names):
            known.pop(str(event.runId), None)


class IngestCounts(StreamingQueryListener):
    """Valid and invalid lines of a running ingest stream, from the metrics
    that its write observes (``ingest.observed`` with ``name``); by batch, so
    that a replayed batch counts once."""

    def __init__(self, name: str = "ingest"):
        self.name = name
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def totals(self) -> dict[str, int]:
        return {k: sum(b[k] for b in self.batches.values()) for k in ("total", "valid", "invalid")}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = {k: int(row[k] or 0) for k in ("total", "valid", "invalid")}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_streams(spark: SparkSession, timeout_s: float | None = None) -> None:
    """Wait for any active query to end; stop them all on interrupt."""
    try:
        spark.streams.awaitAnyTermination(timeout_s)
    except KeyboardInterrupt:
        pass
    finally:
        for q in spark.streams.active:
            q.stop()


def stream_staleness(state: dict | None, stale_seconds: int = S.STALE_SECONDS, now: float | None = None) -> dict:
    """Seconds since the last micro-batch that brought rows (L6), from the
    row that ``RunningTotal.current`` returns."""
    last = state and state["last_input_us"]
    if not last:
        return {"last_input_us": None, "stale": True}
    age = (time.time() if now is None else now) - last / 1e6
    return {"last_input_us": last, "seconds_since_input": age, "stale": age > stale_seconds}


def live_rate(query: StreamingQuery, state: dict | None) -> dict:
    """Arrival rate of the last micro-batch (A25: rows over the time since the
    batch before it) and the running total (A26)."""
    last = query.lastProgress or {}
    return {
        "last_batch_rows": state["last_batch_rows"] if state else 0,
        "events_per_sec": round(float(last.get("inputRowsPerSecond", 0.0) or 0.0), 2),
        "total_received": state["total_received"] if state else 0,
    }
