"""Live-view operators (batch forms): dedup, newest-N buffer, live counts.

The streaming forms in ``recentlake.streaming.live`` apply the same functions
to each micro-batch (``foreachBatch``) or use the streaming aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators.ranking import top_n


def dedupe_offsets(events: DataFrame, partition_col: str = "kafka_partition", offset_col: str = "kafka_offset",
                   order_cols: Sequence[str] | None = None) -> DataFrame:
    """Drop redelivered messages: one row per (partition, offset).

    Rows lacking both partition and offset are all kept.  Without
    ``order_cols`` any copy is kept (copies of one message are identical);
    with it, the smallest order wins.  Both forms are hash aggregates that
    combine map-side, so many copies of one key never meet in one task.
    """
    p, o = F.col(partition_col), F.col(offset_col)
    # Rows without partition and offset get a unique extra key, so a single
    # aggregate (one scan, one shuffle) keeps all of them and dedups the rest.
    lone = F.when(p.isNull() & o.isNull(), F.monotonically_increasing_id())
    tagged = events.withColumn("_lone", lone)
    keys = [partition_col, offset_col, "_lone"]
    if order_cols:
        rest = [c for c in events.columns if c not in (partition_col, offset_col)]
        first = tagged.groupBy(*keys).agg(
            F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order_cols])).alias("_r")
        )
        return first.select(*[F.col(f"_r.{c}").alias(c) if c in rest else F.col(c) for c in events.columns])
    return tagged.dropDuplicates(keys).select(*events.columns)


def buffer_sort_key(ingestion_timestamp: str = "ingestion_timestamp") -> Column:
    """µs of the parsed ingestion time; unparseable -> 0 (sorts last)."""
    ts = F.try_to_timestamp(C.nonempty(C.strip_ws(ingestion_timestamp)))
    return F.coalesce(F.unix_micros(ts), F.lit(0).cast("long"))


def newest_order(tie_cols: Sequence[str] = ("kafka_partition", "kafka_offset")) -> list[Column]:
    return [buffer_sort_key().desc()] + [F.col(c).asc_nulls_first() for c in tie_cols]


def newest_keys(events: DataFrame, n: int, partition_col: str = "kafka_partition",
                offset_col: str = "kafka_offset") -> DataFrame:
    """(partition, offset, time) of the ``n`` newest messages, three longs.

    Redelivered messages are one key with the time of the newest copy.
    Messages without partition and offset are one key for each time, so the
    keys cover at least ``n`` distinct messages.
    """
    p, o, us = F.col(partition_col).cast("long"), F.col(offset_col).cast("long"), buffer_sort_key()
    lone = F.when(p.isNull() & o.isNull(), us)
    narrow = events.select(p.alias("_part"), o.alias("_offset"), lone.alias("_lone"), us.alias("_us"))
    first = narrow.groupBy("_part", "_offset", "_lone").agg(F.max("_us").alias("_us"))
    order = [F.col("_us").desc(), F.col("_part").asc_nulls_first(), F.col("_offset").asc_nulls_first()]
    return first.orderBy(*order).limit(n).select("_part", "_offset", "_us")


def live_buffer(events: DataFrame, n: int = S.LIVE_MAX_EVENTS, partition_col: str = "kafka_partition",
                offset_col: str = "kafka_offset") -> DataFrame:
    """Newest ``n`` distinct events by ingestion time (the live buffer).

    The choice is a top-k over narrow keys (TakeOrderedAndProject: each
    partition keeps its own newest n).  The rows are then fetched by a
    semi-join with at most ``n`` keys, and only they are deduplicated and cut.
    """
    keys = newest_keys(events, n, partition_col, offset_col)
    same = (F.col(partition_col).cast("long").eqNullSafe(F.col("_part"))
            & F.col(offset_col).cast("long").eqNullSafe(F.col("_offset")) & (buffer_sort_key() == F.col("_us")))
    # at most n rows by construction, n being the view's fixed size
    newest = events.join(F.broadcast(keys), same, "left_semi")
    order = newest_order((partition_col, offset_col))
    return dedupe_offsets(newest, partition_col, offset_col).orderBy(*order).limit(n)


def latest_events(events: DataFrame, n: int = S.LIVE_TABLE_ROWS) -> DataFrame:
    """Newest ``n`` events with UTC and local-time labels (live table)."""
    ts = F.try_to_timestamp(C.nonempty(C.strip_ws("ingestion_timestamp")))
    newest = live_buffer(events, n).orderBy(*newest_order())
    return newest.select(
        "title", "wiki", "user", "event_type", "is_bot",
        C.format_utc_label(ts).alias("ingestion_utc"),
        C.format_local_time(ts).alias("ingestion_local"),
    )


def latest_event(events: DataFrame) -> DataFrame:
    """Newest event's raw ingestion time and its UTC / local labels."""
    newest = events.agg(
        F.max_by(F.col("ingestion_timestamp"), F.struct(buffer_sort_key(), F.col("kafka_partition"),
                                                        F.col("kafka_offset"))).alias("raw")
    )
    ts = F.try_to_timestamp(C.nonempty(C.strip_ws("raw")))
    return newest.select(
        F.coalesce(F.col("raw"), F.lit("—")).alias("latest_raw"),
        C.format_utc_label(ts).alias("latest_utc"),
        C.format_local_time(ts).alias("latest_local"),
    )


def live_top_pages(buffer: DataFrame, n: int = S.LIVE_TOP_N, max_len: int = S.TITLE_MAX_LEN) -> DataFrame:
    """Page counts over the buffer, '?' for missing keys, shortened label."""
    counts = (
        buffer.select(C.or_default("title", S.LIVE_MISSING).alias("title"),
                      C.or_default("wiki", S.LIVE_MISSING).alias("wiki"))
        .groupBy("title", "wiki").agg(F.count(F.lit(1)).alias("edit_count"))
    )
    ranked = top_n(counts, n, "edit_count", ["title", "wiki"])
    label = C.page_label(C.shorten_title("title", max_len), F.col("wiki"))
    return ranked.select("rank", label.alias("page"), "edit_count")


def live_by_wiki(buffer: DataFrame, n: int = S.LIVE_TOP_N) -> DataFrame:
    counts = buffer.select(C.page_wiki("wiki").alias("wiki")).groupBy("wiki").agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return top_n(counts, n, "event_count", ["wiki"]).select("rank", "wiki", "event_count")


def live_metrics(buffer: DataFrame) -> DataFrame:
    """Buffer size, bots (is_bot true) and humans (the rest)."""
    c = buffer.agg(F.count(F.lit(1)).alias("buffered"), F.count_if(C.is_true("is_bot")).alias("bots"))
    return c.select("buffered", "bots", (F.col("buffered") - F.col("bots")).alias("humans"))


def live_bot_share(buffer: DataFrame) -> DataFrame:
    """Bots vs humans over the buffer (L5), with the bot percentage."""
    m = live_metrics(buffer)
    return m.select("bots", "humans", C.pct("bots", "buffered").alias("bot_percentage"))


def data_freshness(events: DataFrame, as_of: Column, minutes: int = S.FRESHNESS_MINUTES) -> DataFrame:
    """Newest event time and its freshness status at ``as_of``."""
    from recentlake.operators.reports import _ts

    latest = events.agg(F.max(_ts(events)).alias("latest"))
    return latest.select(
        F.when(F.col("latest").isNotNull(), C.iso_utc("latest")).alias("latest_event_time"),
        C.freshness("latest", as_of, minutes).alias("status"),
    )
