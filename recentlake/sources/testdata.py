"""Adapters from the generic test tables to this library's inputs.

The test tables hold an ``events`` table (event_id, ts, user_id, event_type,
value, props).  ``processed_events`` turns it into processed change events
(the lake schema), with nulls, blanks and odd values injected by event_id so
every rule and default has rows to act on.  Event time is compressed 720
times (30 days -> 1 hour) so that 5-minute rules see dense pages.

Every row of the input is kept: the modulo tests below only decide which
fields are blanked, never which rows are read.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.session import ensure_session_conf

# Fixed values of the fixture.
EPOCH_US = 1_704_067_200_000_000          # 2024-01-01 00:00:00 UTC
AS_OF_US = 1_704_070_200_000_000          # 2024-01-01 00:50:00 UTC
AS_OF = "2024-01-01 00:50:00"
TIME_COMPRESSION = 720
# One page has every 17th event within one minute.
HOT_EVERY = 17
HOT_MINUTE_US = EPOCH_US + 1_800_000_000
LONG_TITLE = " with a long subtitle, longer than labels of live charts are"


def as_of_col() -> Column:
    return F.timestamp_micros(F.lit(AS_OF_US))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_session_conf(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _adapter_columns(compression: int) -> dict[str, Column]:
    eid, uid = F.col("event_id"), F.col("user_id")
    k = F.get_json_object(F.col("props"), "$.k")
    null_str = F.lit(None).cast("string")
    hot = eid % HOT_EVERY == 8
    title = (
        F.when(eid % 101 == 0, null_str).when(eid % 53 == 0, F.concat(F.lit("p"), k))
        .when(eid % 71 == 6, F.concat(F.lit("page_"), k, F.lit(LONG_TITLE)))
        .when(hot, F.lit("hot_page")).otherwise(F.concat(F.lit("page_"), k))
    )
    wiki = (
        F.when(hot, F.lit("enwiki"))
        .when(eid % 97 == 0, null_str)
        .when(eid % 89 == 0, F.lit("unknown"))
        .when(eid % 83 == 0, F.lit(""))
        .when(uid % 5 == 0, F.lit("enwiki"))
        .when(uid % 5 == 1, F.lit("frwiki"))
        .when(uid % 5 == 2, F.lit("dewiki"))
        .when(uid % 5 == 3, F.lit("wikidatawiki"))
        .otherwise(F.lit("meta.example.org"))
    )
    user = F.when(eid % 103 == 0, null_str).when(
        uid % 13 == 0, F.concat(F.lit("10.0.0."), uid.cast("string"))
    ).otherwise(F.concat(F.lit("user_"), uid.cast("string")))
    is_bot = F.when(eid % 107 == 0, F.lit(None).cast("boolean")).otherwise(uid % 7 == 0)
    is_anon = F.when(eid % 109 == 0, F.lit(None).cast("boolean")).otherwise(uid % 13 == 0)
    etype = (
        F.when(F.col("event_type") == "view", F.lit("edit"))
        .when(F.col("event_type") == "click", F.lit("Annotate"))
        .when(F.col("event_type") == "signup", F.lit("new"))
        .when(F.col("event_type") == "error", F.lit("delete"))
        .otherwise(F.lit("categorize"))
    )
    event_us = F.when(eid % 113 == 0, F.lit(None).cast("long")).when(
        hot, F.lit(HOT_MINUTE_US) + (eid * 104_729) % 60_000_000
    ).otherwise(
        F.lit(EPOCH_US) + F.expr(f"(unix_micros(CAST(ts AS TIMESTAMP)) - {EPOCH_US}) div {compression}")
    )
    return {
        "event_id": eid,
        "title": title,
        "wiki": wiki,
        "user": user,
        "is_bot": is_bot,
        "is_anonymous": is_anon,
        "event_type": etype,
        "event_us": event_us,
        "kafka_partition": (eid % 3).cast("int"),
        "kafka_offset": F.expr("event_id div 3"),
        "page_id": F.when(eid % 127 == 0, null_str).otherwise(k),
        "user_id": uid,
    }


def processed_events(events: DataFrame, source: str = S.DEFAULT_SOURCE,
                     compression: int = TIME_COMPRESSION) -> DataFrame:
    """events table -> processed change events (PROCESSED columns + event_id)."""
    cols = _adapter_columns(compression)
    base = events.select(*[c.alias(n) for n, c in cols.items()])
    t = F.timestamp_micros(F.col("event_us"))
    return base.select(
        "event_id",
        F.col("wiki").alias("kafka_key"),
        F.lit(S.TOPIC_RAW).alias("kafka_topic"),
        "kafka_partition",
        "kafka_offset",
        t.alias("kafka_timestamp"),
        "title",
        "wiki",
        "user",
        "is_bot",
        "is_anonymous",
        "event_type",
        C.iso_utc(t).alias("ingestion_timestamp"),
        F.lit(source).alias("source"),
        F.col("wiki").alias("partition_key"),
        "page_id",
        t.alias("event_time"),
    )


def load_processed(spark: SparkSession, sf_dir: str, compression: int = TIME_COMPRESSION) -> DataFrame:
    """``compression=1`` keeps the table's own 30 days."""
    return processed_events(read_table(spark, sf_dir, "events"), compression=compression)


def raw_feed(events: DataFrame) -> DataFrame:
    """events table -> raw feed lines ``(event_id, value)`` as JSON text.

    Fields follow the public change feed: title, wiki, server_name, timestamp
    (epoch seconds), user, userid, bot, anonymous, type, page_id, meta{domain,
    dt, id}.  Fallback fields are filled on some rows only, and a few lines
    are replaced by broken text, so each validation branch is reached.  Some
    flags are text (``"bot":"false"``, ``"anonymous":"true"``,
    ``"userid":"0"``) and some objects repeat a key.
    """
    cols = _adapter_columns(TIME_COMPRESSION)
    eid = F.col("event_id")
    base = events.select(*[c.alias(n) for n, c in cols.items()])
    t = F.timestamp_micros(F.col("event_us"))
    null_str = F.lit(None).cast("string")
    obj = F.struct(
        F.when(eid % 229 == 9, F.lit("   ")).otherwise(F.col("title")).alias("title"),
        F.col("wiki").alias("wiki"),
        F.when(eid % 7 == 1, F.concat(F.lit("srv"), (F.col("user_id") % 5).cast("string"), F.lit(".example.org"))
               ).alias("server_name"),
        F.when(eid % 2 == 0, F.expr("event_us div 1000000")).alias("timestamp"),
        F.col("user").alias("user"),
        F.when(eid % 31 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")).alias("userid"),
        F.col("is_bot").alias("bot"),
        F.col("is_anonymous").alias("anonymous"),
        F.col("event_type").alias("type"),
        F.col("page_id").cast("long").alias("page_id"),
        F.struct(
            F.when(eid % 11 == 2, F.lit("meta-domain.example.org")).otherwise(null_str).alias("domain"),
            F.when((eid % 2 == 1) & F.col("event_us").isNotNull(), C.iso_utc(t)).otherwise(null_str).alias("dt"),
            F.when(eid % 3 != 0, F.concat(F.lit("evt-"), eid.cast("string"))).otherwise(null_str).alias("id"),
        ).alias("meta"),
    )
    value = (
        F.when(eid % 211 == 5, F.lit("{bad"))
        .when(eid % 223 == 7, F.lit("[1]"))
        .when(eid % 61 == 3, F.regexp_replace(F.to_json(obj), '"bot":(true|false)', '"bot":"false"'))
        .when(eid % 59 == 4, F.regexp_replace(F.regexp_replace(
            F.to_json(obj), '"userid":[0-9]+', '"userid":"0"'), '"anonymous":(true|false)', '"anonymous":"true"'))
        .when(eid % 67 == 5, F.regexp_replace(F.to_json(obj), "[}]$", ',"type":"edit"}'))
        .otherwise(F.to_json(obj))
    )
    return base.select("event_id", value.alias("value"))


def load_raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The test table is one row group and building its JSON text costs CPU: the
    # fixture always spreads it.
    return raw_feed(read_table(spark, sf_dir, "events").repartition("event_id"))


def duplicated_events(processed: DataFrame) -> DataFrame:
    """Processed events with every 50th event delivered twice (redelivery)."""
    return processed.unionByName(processed.filter(F.col("event_id") % 50 == 0))
