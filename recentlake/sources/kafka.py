"""Kafka source (S1, S11-S15) and message decoding.

The Kafka connector jar is not bundled with PySpark; ``kafka_reader`` only
builds the reader and fails at ``load()`` when the connector is absent.  The
decoding works on any DataFrame with Kafka's columns (key, value, topic,
partition, offset, timestamp), e.g. a file stream used in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C


def kafka_options(bootstrap: str, topic: str, group: str | None = None, mode: str = "replay",
                  max_offsets_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """Stream reader options.  ``mode='replay'`` starts from the earliest
    offsets (first start only: a checkpoint takes over afterwards);
    ``mode='new'`` reads only messages arriving after the start.  Offsets
    that are gone from the broker end the query, unless told otherwise."""
    if mode not in ("replay", "new"):
        raise ValueError(f"unknown mode {mode!r}")
    opts = {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": "earliest" if mode == "replay" else "latest",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if group:
        opts["kafka.group.id"] = group
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def kafka_reader(spark: SparkSession, bootstrap: str, topic: str, group: str | None = None,
                 mode: str = "replay", max_offsets_per_trigger: int | None = None):
    """``readStream`` on one topic."""
    return spark.readStream.format("kafka").options(**kafka_options(bootstrap, topic, group, mode, max_offsets_per_trigger))


def batch_options(bootstrap: str, topic: str, since_ms: int | None = None) -> dict[str, str]:
    """Batch reader options: the whole topic as it is now, or its messages
    from a time on.  A batch has no "latest" start: to read only what came
    after the last run use a stream with ``trigger(availableNow=True)``, whose
    checkpoint stores the offsets."""
    start = {"startingOffsets": "earliest"} if since_ms is None else {
        "startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"}
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "endingOffsets": "latest", **start}


def read_topic(spark: SparkSession, bootstrap: str, topic: str, since_ms: int | None = None) -> DataFrame:
    """Bounded batch read of a topic, decoded to processed events."""
    rows = spark.read.format("kafka").options(**batch_options(bootstrap, topic, since_ms)).load()
    return add_event_time(decode_kafka(rows))


def read_events_stream(spark: SparkSession, bootstrap: str, topic: str = S.TOPIC_RAW,
                       group: str | None = None, mode: str = "replay",
                       max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Processed events from a Kafka topic (S1 + E1 + E2)."""
    raw = kafka_reader(spark, bootstrap, topic, group, mode, max_offsets_per_trigger).load()
    return add_event_time(decode_kafka(raw))


def decode_kafka(kafka_rows: DataFrame) -> DataFrame:
    """Kafka rows -> processed columns: key/value as text, record fields
    parsed with the fixed record schema, Kafka metadata renamed kafka_*.

    Values that are not JSON objects give null record fields (the row is
    kept, as the studied stream job does); live views read ``json_objects``.
    The ``kafka_*`` names are the lake's (``schema.KAFKA_COLUMNS``).
    """
    rec = F.from_json(F.col("value").cast("string"), S.STREAM_RECORD)
    staged = kafka_rows.select(
        F.col("key").cast("string").alias("kafka_key"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        rec.alias("_rec"),
    )
    return staged.select(
        "kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp",
        *[F.col(f"_rec.{f.name}").alias(f.name) for f in S.STREAM_RECORD.fields],
    )


def add_event_time(events: DataFrame) -> DataFrame:
    """``event_time`` from ``ingestion_timestamp`` (unparseable -> null)."""
    return events.withColumn("event_time", F.try_to_timestamp(C.nonempty(C.strip_ws("ingestion_timestamp"))))


def _is_object(value) -> Column:
    """The message value is a JSON object."""
    return F.coalesce(F.get_json_object(value.cast("string"), "$").startswith("{"), F.lit(False))


def json_objects(kafka_rows: DataFrame) -> DataFrame:
    """Messages whose value is a JSON object: the only ones live views show."""
    return kafka_rows.filter(_is_object(F.col("value")))


def other_messages(kafka_rows: DataFrame) -> DataFrame:
    """Messages whose value is anything else."""
    return kafka_rows.filter(~_is_object(F.col("value")))
