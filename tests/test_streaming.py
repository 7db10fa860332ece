"""Streaming forms give the batch results; restarts do not duplicate."""

import json
import os

from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import ingest as I
from recentlake.operators import anomalies as A
from recentlake.operators import live as L
from recentlake.operators import reports as R
from recentlake.sources import files as SRC
from recentlake.sources import testdata as TD
from recentlake.streaming import etl as ETL
from recentlake.streaming import live as LV
from recentlake.sinks import writers as W

SF = "/root/testdata/sf0.001"


def _write_raw_files(spark, scratch, n_files=4):
    raw = TD.load_raw_feed(spark, SF)
    raw_dir = os.path.join(scratch, "raw")
    raw.withColumn("_b", F.col("event_id") % n_files).repartition(n_files, "_b") \
        .select("value").write.text(raw_dir)
    return raw_dir


def test_ingest_stream_equals_batch(spark, scratch):
    raw_dir = _write_raw_files(spark, scratch)
    fixed = F.to_timestamp(F.lit("2024-01-01 00:50:00"))
    stream = SRC.read_raw_events(spark, raw_dir, streaming=True, max_files_per_trigger=1)
    q = (ETL.ingest_stream(stream, fixed).writeStream.format("memory").queryName("ingest_out")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("ingest_out").collect())
    batch = I.ingest_messages(SRC.read_raw_events(spark, raw_dir), fixed)
    want = sorted(tuple(r) for r in batch.collect())
    assert got == want and len(got) > 1000


def test_live_stream_drops_other_messages(spark, scratch):
    rows = spark.createDataFrame([(b"k", v, "t", 0, i, None) for i, v in enumerate(
        (b'{"title": "A"}', b"not json", b"[1]", b"null", None, b' {"title": "B"}'))], S.KAFKA_ROW)
    src = os.path.join(scratch, "kafka")
    rows.write.parquet(src)
    stream = spark.readStream.schema(S.KAFKA_ROW).parquet(src)
    q = (ETL.live_stream(stream).writeStream.format("memory").queryName("live_out")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sorted(r["title"] for r in spark.table("live_out").collect()) == ["A", "B"]


def test_processed_sink_restart_no_duplicates(spark, scratch):
    raw_dir = _write_raw_files(spark, scratch)
    fixed = F.to_timestamp(F.lit("2024-01-01 00:50:00"))
    out, ck = os.path.join(scratch, "processed"), os.path.join(scratch, "ck")

    def run_once():
        stream = SRC.read_raw_events(spark, raw_dir, streaming=True, max_files_per_trigger=1)
        events = ETL.messages_as_processed(ETL.ingest_stream(stream, fixed))
        q = W.write_processed_stream(events, out, ck, trigger={"availableNow": True})
        q.awaitTermination(120)

    run_once()
    first = spark.read.schema(S.PROCESSED).parquet(out).count()
    run_once()  # same checkpoint: nothing new to do
    assert spark.read.schema(S.PROCESSED).parquet(out).count() == first
    valid = I.validation_counts(I.validate_events(SRC.read_raw_events(spark, raw_dir))).first()["valid"]
    assert first == valid


def test_dedupe_stream_and_minute_counts(spark, scratch):
    ev = TD.duplicated_events(TD.load_processed(spark, SF))
    # rows without a key are no copies of each other
    lone = ev.filter(F.col("event_id") % 40 == 0).withColumn("kafka_partition", F.lit(None).cast("int")) \
        .withColumn("kafka_offset", F.lit(None).cast("long"))
    ev = ev.unionByName(lone)
    src = os.path.join(scratch, "events")
    ev.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (LV.dedupe_stream(stream, "365 days").writeStream.format("memory").queryName("dedup_out")
         .option("checkpointLocation", os.path.join(scratch, "ck1")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    want = L.dedupe_offsets(ev).count()
    assert spark.table("dedup_out").count() == want

    as_of = F.to_timestamp(F.lit("2024-01-01 00:50:00"))
    counts = LV.per_minute_counts(stream, "1 minute", by=(), untimed_at=as_of)
    q2 = (counts.writeStream.format("memory").queryName("minute_out").outputMode("complete")
          .option("checkpointLocation", os.path.join(scratch, "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(120)
    got = {r["minute"]: r["n"] for r in spark.table("minute_out").groupBy("minute").agg(F.sum("event_count").alias("n")).collect()}
    timed = ev.drop("ingestion_timestamp", "kafka_timestamp")
    assert got == {r["minute"]: r["event_count"] for r in R.activity_by_minute(timed).collect()}

    rate = LV.bot_rate_stream(stream, "1 minute", threshold=5, untimed_at=as_of)
    q3 = (rate.writeStream.format("memory").queryName("rate_out").outputMode("complete")
          .option("checkpointLocation", os.path.join(scratch, "ck3")).trigger(availableNow=True).start())
    q3.awaitTermination(120)
    keyed = A._keyed(timed, as_of, ("event_id",))
    batch = {(r["timestamp"], r["edits_per_minute"]) for r in A.bot_rate(keyed, 5).collect()}
    assert {(r["timestamp"], r["edits_per_minute"]) for r in spark.table("rate_out").collect()} == batch and batch


def test_live_buffer_foreach_batch(spark, scratch):
    ev = TD.load_processed(spark, SF)
    src = os.path.join(scratch, "events")
    ev.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    buf = LV.LiveBuffer(os.path.join(scratch, "buffer"), n=50)
    q = (stream.writeStream.foreachBatch(buf).option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = sorted(r["event_id"] for r in buf.current(spark).collect())
    want = sorted(r["event_id"] for r in L.live_buffer(ev, 50).collect())
    assert got == want


def test_live_buffer_replay_is_idempotent(spark, scratch):
    ev = TD.load_processed(spark, SF)
    parts = [ev.filter(F.col("event_id") % 3 == k) for k in range(3)]
    buf = LV.LiveBuffer(os.path.join(scratch, "buffer"), n=40)
    for b, part in enumerate(parts):
        buf(part, b)
    once = sorted(r["event_id"] for r in buf.current(spark).collect())
    buf(parts[2], 2)  # batch 2 delivered again after a failure
    assert sorted(r["event_id"] for r in buf.current(spark).collect()) == once
    assert once == sorted(r["event_id"] for r in L.live_buffer(ev, 40).collect())


def test_fan_out_rate_and_staleness(spark, scratch):
    ev = TD.load_processed(spark, SF)
    src = os.path.join(scratch, "events")
    ev.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen = {}

    def count_sink(name):
        def sink(batch, batch_id):
            seen[(name, batch_id)] = batch.count()
        return sink

    total = LV.RunningTotal(os.path.join(scratch, "total"))
    q = ETL.fan_out(stream, {"a": count_sink("a"), "b": count_sink("b"), "total": total}, os.path.join(scratch, "ck"),
                    trigger={"availableNow": True})
    q.awaitTermination(120)
    a = sum(v for (n, _), v in seen.items() if n == "a")
    b = sum(v for (n, _), v in seen.items() if n == "b")
    assert a == b == ev.count()
    rate = ETL.live_rate(q, total.current(spark))
    assert rate["total_received"] == ev.count() and rate["last_batch_rows"] > 0
    stale = ETL.stream_staleness(total.current(spark), stale_seconds=3600)
    assert stale["stale"] is False and stale["last_input_us"] is not None
    assert ETL.stream_staleness(None)["stale"] is True


def test_running_total_after_many_batches(spark, scratch):
    total = LV.RunningTotal(os.path.join(scratch, "total"))
    for b in range(150):
        total(spark.range(b % 3), b)
    total(spark.range(149 % 3), 149)  # delivered again
    assert total.current(spark)["total_received"] == sum(b % 3 for b in range(150))


def test_live_totals(spark, scratch):
    ev = TD.load_processed(spark, SF)
    src = os.path.join(scratch, "events")
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (LV.live_totals(stream).writeStream.format("memory").queryName("totals_out").outputMode("complete")
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("totals_out").agg(F.sum("events"), F.sum("bots")).first() == ev.agg(F.count("*"), F.count_if("is_bot")).first()
