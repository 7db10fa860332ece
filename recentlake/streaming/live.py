"""Live views on streams (L1-L8): dedup, windowed counts, newest-N buffer.

* ``dedupe_stream``: redelivered (partition, offset) pairs dropped with
  bounded state (``dropDuplicatesWithinWatermark``).
* ``per_minute_counts`` / ``bot_rate_stream``: tumbling one-minute windows
  with a watermark, so state for closed minutes is dropped.
* ``RunningTotal``: rows received so far, kept in the sink.
* ``LiveBuffer``: a ``foreachBatch`` function keeping the newest N events in
  a small table, idempotent per batch id.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import live as L


def dedupe_stream(events: DataFrame, watermark: str = "10 minutes", time_col: str = "event_time",
                  partition_col: str = "kafka_partition", offset_col: str = "kafka_offset") -> DataFrame:
    """Drop redelivered messages within the watermark delay.

    Rows without partition and offset are no redelivery of each other: they
    go past the dedup, as in the batch form.
    """
    keyless = F.col(partition_col).isNull() & F.col(offset_col).isNull()
    timed = events.withWatermark(time_col, watermark)
    keyed = timed.filter(~keyless).dropDuplicatesWithinWatermark([partition_col, offset_col])
    return keyed.unionByName(timed.filter(keyless))


def _placed(events: DataFrame, time_col: str, untimed_at: Column | None) -> DataFrame:
    """``_at``: the event's time, or for events without one ``untimed_at``
    (the processing time by default)."""
    fallback = F.current_timestamp() if untimed_at is None else untimed_at
    return events.withColumn("_at", F.coalesce(F.col(time_col), fallback))


def per_minute_counts(events: DataFrame, watermark: str = "10 minutes", time_col: str = "event_time",
                      by: tuple[str, ...] = ("wiki",), untimed_at: Column | None = None) -> DataFrame:
    """Events per one-minute window (and ``by`` columns), append mode once
    the watermark passes the window end.

    Events without a time count in the minute 'unknown', as in the batch
    report; they arrive with the window of ``untimed_at``.
    """
    keys = [C.page_wiki(c).alias(c) if c == "wiki" else F.col(c) for c in by]
    return (
        _placed(events, time_col, untimed_at).withWatermark("_at", watermark)
        .groupBy(F.window("_at", "1 minute").alias("window"), F.col(time_col).isNull().alias("_untimed"), *keys)
        .agg(F.count(F.lit(1)).alias("event_count"),
             F.count_if(C.is_true("is_bot")).alias("bot_count"))
        .select(F.when(F.col("_untimed"), F.lit(S.UNKNOWN)).otherwise(C.minute_bucket("window.start")).alias("minute"),
                *by, "event_count", "bot_count")
    )


def bot_rate_stream(events: DataFrame, watermark: str = "10 minutes", time_col: str = "event_time",
                    threshold: int = S.BOT_EDITS_PER_MIN_THRESHOLD, untimed_at: Column | None = None) -> DataFrame:
    """Bot-rate anomaly rows (Q8) emitted once each minute closes; events
    without a time are placed at ``untimed_at``, as the batch rule does."""
    per_min = (
        _placed(events.filter(C.is_true("is_bot")), time_col, untimed_at).withWatermark("_at", watermark)
        .groupBy(F.window("_at", "1 minute").alias("window"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= threshold)
    )
    return per_min.select(
        F.lit(S.ANOMALY_BOT).alias("type"), F.lit(S.BOT_PAGE_LABEL).alias("page"),
        F.lit(S.SEVERITY_HIGH).alias("severity"),
        F.concat(C.minute_bucket("window.start"), F.lit(":00+00:00")).alias("timestamp"),
        F.col("n").alias("edits_per_minute"), F.lit(threshold).cast("long").alias("threshold"),
        F.lit(S.RULE_BOT_RATE).alias("reason"),
    )


def live_totals(events: DataFrame) -> DataFrame:
    """Running bot / human / per-wiki counts (complete mode, small state)."""
    return events.groupBy(C.page_wiki("wiki").alias("wiki")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(C.is_true("is_bot")).alias("bots"))


def _read_slot(spark, path: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) or "UNABLE_TO_INFER" in str(exc):
            return None
        raise
    return df if "_batch" in df.columns else None


class RunningTotal:
    """``foreachBatch`` sink with the number of rows received so far (A26) and
    the time of the last batch that brought rows (L6).

    One row in two alternating slots under ``path``, like :class:`LiveBuffer`:
    batch b adds to the row of batch b-1, so the total does not depend on how
    many progress reports a query keeps, outlives restarts, and a replayed
    batch counts once.
    """

    def __init__(self, path: str):
        self.path = path

    def _slot(self, batch_id: int) -> str:
        return os.path.join(self.path, f"slot={batch_id % 2}")

    def current(self, spark) -> dict | None:
        """``total_received, last_batch_rows, last_input_us`` of the newest batch."""
        rows = [r for s in (0, 1) if (f := _read_slot(spark, os.path.join(self.path, f"slot={s}"))) is not None
                for r in f.collect()]  # one row in each slot
        return max((r.asDict() for r in rows), key=lambda r: r["_batch"], default=None)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slot = _read_slot(spark, self._slot(batch_id - 1)) if batch_id > 0 else None
        before = next((r for r in (slot.collect() if slot is not None else []) if r["_batch"] == batch_id - 1), None)
        total, last = (before["total_received"], before["last_input_us"]) if before else (0, None)
        one = batch.agg(F.count(F.lit(1)).alias("last_batch_rows")).select(
            F.lit(batch_id).cast("long").alias("_batch"), (F.col("last_batch_rows") + F.lit(total)).alias("total_received"),
            "last_batch_rows",
            F.when(F.col("last_batch_rows") > 0, F.unix_micros(F.current_timestamp())).otherwise(F.lit(last).cast("long")).alias("last_input_us"))
        one.write.mode("overwrite").parquet(self._slot(batch_id))


class LiveBuffer:
    """``foreachBatch`` sink keeping the newest ``n`` distinct events.

    State is a table of at most ``n`` rows in two alternating slots under
    ``path`` (slot = batch id mod 2), each row tagged with the batch id that
    wrote it.  Batch b reads only the slot of batch b-1 and overwrites the
    other one, so it never overwrites what it reads, and replaying batch b
    after a failure rewrites the same result: idempotent, with no
    driver-side state.
    """

    def __init__(self, path: str, n: int = S.LIVE_MAX_EVENTS):
        self.path = path
        self.n = n

    def _slot(self, batch_id: int) -> str:
        return os.path.join(self.path, f"slot={batch_id % 2}")

    def current(self, spark) -> DataFrame | None:
        """The newest complete buffer (for readers of the live view)."""
        frames = [f for f in (_read_slot(spark, os.path.join(self.path, f"slot={s}")) for s in (0, 1)) if f is not None]
        if not frames:
            return None
        both = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        newest = both.agg(F.max("_batch").alias("_b"))
        return both.join(newest, both["_batch"] == newest["_b"], "left_semi").drop("_batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur = batch.select(*[c for c in batch.columns if c != "_batch"])
        prev = _read_slot(spark, self._slot(batch_id - 1)) if batch_id > 0 else None
        if prev is not None:
            prev = prev.filter(F.col("_batch") == batch_id - 1)
            cur = cur.unionByName(prev.drop("_batch"), allowMissingColumns=True)
        newest = L.live_buffer(cur, self.n).withColumn("_batch", F.lit(batch_id).cast("long"))
        newest.write.mode("overwrite").parquet(self._slot(batch_id))

    def reset(self, spark) -> None:
        """Start a new buffer (L8): both slots emptied."""
        for s in (0, 1):
            spark.createDataFrame([], "_batch long").write.mode("overwrite").parquet(
                os.path.join(self.path, f"slot={s}"))
