"""Report operators (A1-A20): ``processed events DataFrame -> DataFrame``.

Each report is one scan, a map-side partial aggregate, one shuffle of the
(small) partial results and, for rankings, a top-k merge.  Catalyst prunes the
scan to the few columns a report touches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators.frames import combine_rows
from recentlake.operators.ranking import sorted_counts, top_counts, top_n
from recentlake.session import reuse


MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000


def _ts(events: DataFrame) -> Column:
    cols = set(events.columns)
    return C.event_ts(
        "event_time" if "event_time" in cols else F.lit(None).cast("timestamp"),
        "ingestion_timestamp" if "ingestion_timestamp" in cols else F.lit(None).cast("string"),
        "kafka_timestamp" if "kafka_timestamp" in cols else F.lit(None).cast("timestamp"),
    )


def require_non_empty(events: DataFrame, what: str = "events") -> DataFrame:
    """Raise when the input is empty (a one-row probe job, not a count)."""
    if events.isEmpty():
        raise ValueError(f"no {what} to report on")
    return events


# ---------------------------------------------------------------------------
# A1-A2: batch job summary
# ---------------------------------------------------------------------------

def batch_summary(events: DataFrame) -> DataFrame:
    """Total, bots (is_bot = true), humans (is_bot = false; null in neither)."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("is_bot") == F.lit(True)).alias("bot_events"),
        F.count_if(F.col("is_bot") == F.lit(False)).alias("human_events"),
    )


def batch_by_wiki(events: DataFrame) -> DataFrame:
    """Events per raw wiki value (null kept as its own group), count-desc."""
    counts = events.groupBy("wiki").agg(F.count(F.lit(1)).alias("event_count"))
    return sorted_counts(counts, "event_count", ["wiki"])


# ---------------------------------------------------------------------------
# Global activity
# ---------------------------------------------------------------------------

def _bucket_counts(events: DataFrame, bucket: Column, name: str) -> DataFrame:
    counts = events.select(bucket.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("event_count"))
    return sorted_counts(counts, "event_count", [name])


def _time_counts(events: DataFrame, width_us: int, label, name: str) -> DataFrame:
    """Counts per time bucket: grouped by the bucket's number (a long), its
    text made afterwards; events without a time are 'unknown'."""
    us = C.bucket_us(F.unix_micros(_ts(events)), width_us)
    counts = events.select(us.alias("_us")).groupBy("_us").agg(F.count(F.lit(1)).alias("event_count"))
    text = F.coalesce(label(F.timestamp_micros("_us")), F.lit(S.UNKNOWN))
    return sorted_counts(counts.select(text.alias(name), "event_count"), "event_count", [name])


def activity_by_minute(events: DataFrame) -> DataFrame:
    return _time_counts(events, MINUTE_US, C.minute_bucket, "minute")


def activity_by_hour(events: DataFrame) -> DataFrame:
    return _time_counts(events, HOUR_US, C.hour_bucket, "hour")


def language_distribution(events: DataFrame) -> DataFrame:
    return _bucket_counts(events, C.wiki_to_language("wiki"), "language")


def activity_by_wiki(events: DataFrame) -> DataFrame:
    return _bucket_counts(events, C.page_wiki("wiki"), "wiki")


def activity_dimensions(events: DataFrame) -> DataFrame:
    """A3-A6 in one scan and one shuffle: (dimension, bucket, event_count).

    GROUPING SETS expands each row four times inside the map-side partial
    aggregate, so the shuffle carries only distinct (dimension, bucket) pairs.
    """
    us = F.unix_micros(_ts(events))
    keyed = events.select(
        C.bucket_us(us, MINUTE_US).alias("minute"),
        C.bucket_us(us, HOUR_US).alias("hour"),
        C.wiki_to_language("wiki").alias("language"),
        C.page_wiki("wiki").alias("wiki"),
    )
    grouped = keyed.groupingSets(
        [["minute"], ["hour"], ["language"], ["wiki"]], "minute", "hour", "language", "wiki"
    ).agg(F.count(F.lit(1)).alias("event_count"), F.grouping_id().alias("gid"))
    # grouping_id bits: minute is the high bit; a set keeps its own bit at 0
    dimension = (
        F.when(F.col("gid") == 7, F.lit("minute"))
        .when(F.col("gid") == 11, F.lit("hour"))
        .when(F.col("gid") == 13, F.lit("language"))
        .otherwise(F.lit("wiki"))
    )
    bucket = F.coalesce(C.minute_bucket(F.timestamp_micros("minute")), C.hour_bucket(F.timestamp_micros("hour")),
                        "language", "wiki", F.lit(S.UNKNOWN))
    return grouped.select(dimension.alias("dimension"), bucket.alias("bucket"), "event_count")


def chart_heads(events: DataFrame, heads: Mapping[str, int] = S.CHART_HEADS) -> DataFrame:
    """The largest entries of every chart (T6): section, rank, label, event_count.

    One scan and one shuffle of partial counts for all sections (GROUPING
    SETS).  The rank's bound is pushed below its exchange (WindowGroupLimit):
    each task keeps the largest of each section, so a section with very many
    pages is never sorted in one task.  Sections are the keys of ``heads``
    (minute, hour, language, wiki, page, user, bot); ties by label.
    """
    us, bot = F.unix_micros(_ts(events)), C.is_true("is_bot")
    keyed = events.select(
        C.bucket_us(us, MINUTE_US).alias("minute"), C.bucket_us(us, HOUR_US).alias("hour"),
        C.wiki_to_language("wiki").alias("language"), C.page_wiki("wiki").alias("wiki"),
        C.page_label(C.page_title("title"), C.page_wiki("wiki")).alias("page"),
        F.when(~bot, C.user_key("user")).alias("user"), F.when(bot, C.user_key("user", S.UNKNOWN_BOT)).alias("bot"),
    )
    names = list(heads)
    text = {"minute": C.minute_bucket(F.timestamp_micros("minute")), "hour": C.hour_bucket(F.timestamp_micros("hour"))}
    # a set keeps its own grouping bit at 0; the first column has the highest
    own = {name: F.col("gid") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - k)) for k, name in enumerate(names)}
    section, label, shown = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for name in names:
        section = F.when(own[name], F.lit(name)).otherwise(section)
        label = F.when(own[name], F.coalesce(text.get(name, F.col(f"`{name}`")), F.lit(S.UNKNOWN))).otherwise(label)
        # the other kind's events have no user here
        shown = F.when(own[name], F.col(name).isNotNull() if name in ("user", "bot") else F.lit(True)).otherwise(shown)
    counts = keyed.groupingSets([[n] for n in names], *names).agg(
        F.count(F.lit(1)).alias("event_count"), F.grouping_id().alias("gid"))
    counts = counts.where(shown).select(section.alias("section"), label.alias("label"), "event_count")
    order = Window.partitionBy("section").orderBy(F.desc("event_count"), "label")
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= max(heads.values()))
    limits = F.create_map(*[F.lit(v) for pair in heads.items() for v in pair])
    return ranked.where(F.col("rank") <= limits[F.col("section")]).select("section", "rank", "label", "event_count")


def global_activity(events: DataFrame, source_path: str | None = None) -> DataFrame:
    """Total events, files read (distinct ``source_file``), source path."""
    files = (
        F.count_distinct("source_file") if "source_file" in events.columns else F.lit(None).cast("long")
    )
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        files.alias("files_read"),
    ).withColumn("source_path", F.lit(source_path).cast("string"))


# ---------------------------------------------------------------------------
# pages
# ---------------------------------------------------------------------------

def _page_counts(events: DataFrame, where: Column | None = None) -> DataFrame:
    src = events if where is None else events.filter(where)
    return (
        src.select(C.page_title("title").alias("title"), C.page_wiki("wiki").alias("wiki"))
        .groupBy("title", "wiki")
        .agg(F.count(F.lit(1)).alias("edit_count"))
    )


def top_pages(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    """Most active pages over all event types: rank, title, wiki, edit_count."""
    return top_n(_page_counts(events), n, "edit_count", ["title", "wiki"]).select(
        "rank", "title", "wiki", "edit_count"
    )


def top_pages_of_many(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    """``top_pages`` for lakes with very many pages: pages that cannot reach
    the top are not shuffled (``ranking.top_counts``)."""
    pages = events.select(C.page_title("title").alias("title"), C.page_wiki("wiki").alias("wiki"))
    return top_counts(pages, n, ["title", "wiki"]).select("rank", "title", "wiki", "edit_count")


def most_created_pages(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    return top_n(_page_counts(events, C.is_create("event_type")), n, "edit_count", ["title", "wiki"]).select(
        "rank", "title", "wiki", "edit_count"
    )


def most_deleted_pages(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    return top_n(_page_counts(events, C.is_delete("event_type")), n, "edit_count", ["title", "wiki"]).select(
        "rank", "title", "wiki", "edit_count"
    )


# ---------------------------------------------------------------------------
# Users and bots
# ---------------------------------------------------------------------------

def top_contributors(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    """Humans only (is_bot not true), by user name ('unknown' if missing)."""
    counts = (
        events.filter(~C.is_true("is_bot"))
        .select(C.user_key("user").alias("user"))
        .groupBy("user")
        .agg(F.count(F.lit(1)).alias("edit_count"))
    )
    return top_n(counts, n, "edit_count", ["user"]).select("rank", "user", "edit_count")


def _bot_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(C.is_true("is_bot")).alias("bots"),
    )


def bots_vs_humans(events: DataFrame) -> DataFrame:
    c = _bot_counts(events)
    return c.select(
        "bots",
        (F.col("total_events") - F.col("bots")).alias("humans"),
        C.pct("bots", "total_events").alias("bot_percentage"),
    )


def anonymous_vs_logged(events: DataFrame) -> DataFrame:
    c = events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(C.is_true("is_anonymous")).alias("anonymous"),
    )
    logged = F.col("total") - F.col("anonymous")
    return c.select(
        "anonymous",
        logged.alias("logged_in"),
        C.pct("anonymous", "total").alias("anonymous_percentage"),
        C.pct(logged, "total").alias("logged_in_percentage"),
    )


def bot_ratio(events: DataFrame) -> DataFrame:
    c = _bot_counts(events)
    return c.select(
        "total_events",
        F.col("bots").alias("bot_volume"),
        (F.col("total_events") - F.col("bots")).alias("human_volume"),
        C.pct("bots", "total_events").alias("bot_percentage"),
    )


def active_bots(events: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    counts = (
        events.filter(C.is_true("is_bot"))
        .select(C.user_key("user", S.UNKNOWN_BOT).alias("bot_user"))
        .groupBy("bot_user")
        .agg(F.count(F.lit(1)).alias("edit_count"))
    )
    return top_n(counts, n, "edit_count", ["bot_user"]).select("rank", "bot_user", "edit_count")


# ---------------------------------------------------------------------------
# Daily report sections
# ---------------------------------------------------------------------------

def daily_global(events: DataFrame, as_of: Column) -> DataFrame:
    """One row: report date, totals, bot/human split."""
    c = _bot_counts(events)
    return c.select(
        F.date_format(as_of, "yyyy-MM-dd").alias("report_date"),
        "total_events",
        "bots",
        (F.col("total_events") - F.col("bots")).alias("humans"),
        C.pct("bots", "total_events").alias("bot_percentage"),
    )


def daily_top_pages(events: DataFrame, n: int = S.DAILY_TOP_LIMIT) -> DataFrame:
    """Top pages with a 'title (wiki)' label."""
    ranked = top_n(_page_counts(events), n, "edit_count", ["title", "wiki"])
    return ranked.select("rank", C.page_label("title", "wiki").alias("page"), "edit_count")


def daily_top_users(events: DataFrame, n: int = S.DAILY_TOP_LIMIT) -> DataFrame:
    """Top users, bots included."""
    counts = (
        events.select(C.user_key("user").alias("user")).groupBy("user").agg(F.count(F.lit(1)).alias("edit_count"))
    )
    return top_n(counts, n, "edit_count", ["user"]).select("rank", "user", "edit_count")


def daily_traffic(events: DataFrame, n_hours: int | None = None) -> DataFrame:
    """Hourly buckets, events without time dropped, largest first.

    ``n_hours`` keeps the largest only (the studied document keeps
    ``DAILY_HOURS_LIMIT``); all hours by default."""
    us = C.bucket_us(F.unix_micros(_ts(events)), HOUR_US)
    counts = (
        events.select(us.alias("_us")).filter(F.col("_us").isNotNull())
        .groupBy("_us").agg(F.count(F.lit(1)).alias("event_count"))
        .select(C.hour_bucket(F.timestamp_micros("_us")).alias("hour"), "event_count")
    )
    # one row for each hour of the lake's time span
    rank = F.row_number().over(Window.orderBy(F.col("event_count").desc(), "hour")).cast("long").alias("rank")
    ranked = counts.select(rank, "hour", "event_count")
    return ranked if n_hours is None else ranked.filter(F.col("rank") <= n_hours)


def invalid_rate(errors: Column, total: Column) -> Column:
    """errors / max(1, errors + total) * 100, two decimals."""
    return F.round(errors.cast("double") / F.greatest(F.lit(1), errors + total).cast("double") * F.lit(100.0), 2)


def daily_quality(anomalies: DataFrame, errors: DataFrame, events: DataFrame) -> DataFrame:
    """Quality section: stored anomaly count, ingestion errors, invalid rate.

    ``errors`` has one row per rejected feed line (error records or the
    errors topic); ``events`` are the processed events.  One row.
    """
    return _quality_from_total(anomalies, errors, events.agg(F.count(F.lit(1)).alias("total_events")))


def _quality_from_total(anomalies: DataFrame, errors: DataFrame, total: DataFrame) -> DataFrame:
    a = anomalies.agg(F.count(F.lit(1)).alias("anomalies_detected"))
    e = errors.agg(F.count(F.lit(1)).alias("ingestion_errors_topic_count"))
    j = combine_rows(a, e, total.select(F.col("total_events").alias("_total")))
    return j.select(
        "anomalies_detected",
        "ingestion_errors_topic_count",
        invalid_rate(F.col("ingestion_errors_topic_count"), F.col("_total")).alias("invalid_events_rate_pct"),
    )


def anomaly_sample(anomalies: DataFrame, n: int | None = None, order: tuple[str, ...] = ("timestamp", "type", "page", "reason")) -> DataFrame:
    """Stored anomalies in order; ``n`` keeps the first (the studied document
    shows ``ANOMALY_SAMPLE``), all of them by default."""
    rows = anomalies.orderBy(*order)
    return rows if n is None else rows.limit(n)


DAILY_SETS = ("total", "page", "user", "hour", "language", "wiki")


def daily_dimensions(events: DataFrame) -> DataFrame:
    """All event counts of the daily document in one scan.

    GROUPING SETS over (page title, page wiki), (user), (hour), (language),
    (wiki) and () with event and bot counts: each row is expanded in the
    map-side partial aggregate and only distinct keys are shuffled.  Output:
    ``dim, k1, k2, event_count, bots`` (small: one row per distinct key).
    """
    keyed = events.select(
        C.page_title("title").alias("p_title"), C.page_wiki("wiki").alias("p_wiki"),
        C.user_key("user").alias("u"), C.bucket_us(F.unix_micros(_ts(events)), HOUR_US).alias("h"),
        C.wiki_to_language("wiki").alias("lang"), C.page_wiki("wiki").alias("w"),
        C.is_true("is_bot").alias("bot"),
    )
    g = keyed.groupingSets(
        [["p_title", "p_wiki"], ["u"], ["h"], ["lang"], ["w"], []], "p_title", "p_wiki", "u", "h", "lang", "w"
    ).agg(F.count(F.lit(1)).alias("event_count"), F.count_if("bot").alias("bots"), F.grouping_id().alias("gid"))
    # grouping_id bits, high to low: p_title p_wiki u h lang w (0 = grouped)
    dim = (F.when(F.col("gid") == 0b001111, F.lit("page")).when(F.col("gid") == 0b110111, F.lit("user"))
           .when(F.col("gid") == 0b111011, F.lit("hour")).when(F.col("gid") == 0b111101, F.lit("language"))
           .when(F.col("gid") == 0b111110, F.lit("wiki")).otherwise(F.lit("total")))
    k1 = F.coalesce("p_title", "u", C.hour_bucket(F.timestamp_micros("h")), "lang", "w")
    return g.select(dim.alias("dim"), k1.alias("k1"), F.col("p_wiki").alias("k2"), "event_count", "bots")


# Sections of the daily document and their files.
GLOBAL_SECTION, QUALITY_SECTION = "global_activity_report", "quality_report"
TRAFFIC_SECTION, SYSTEM_SECTION = "traffic_report", "system_report"


def daily_report(events: DataFrame, as_of: Column, anomalies: DataFrame, topic_volumes: DataFrame,
                 lag: DataFrame | None = None, files_read: DataFrame | None = None,
                 n_hours: int | None = S.DAILY_HOURS_LIMIT, n_anomalies: int | None = S.ANOMALY_SAMPLE) -> DataFrame:
    """The daily document (A20) as rows ``section, item, rank, key, value,
    text``: one row per figure, so that no list or map meets in one task.

    ``value`` holds numbers, ``text`` everything else.  Top lists keep the
    document's own lengths; ``n_hours`` and ``n_anomalies`` may be None for
    all.  The event counts of every section come from one grouping-sets pass,
    materialised once.  ``topic_volumes`` has one row per topic; the errors
    topic counts the ingestion errors.  ``files_read`` and ``lag`` (rows per
    topic and partition) are optional.
    """
    dims = reuse(daily_dimensions(events))
    anomalies = reuse(anomalies)
    volumes = reuse(topic_volumes)

    def part(dim: str) -> DataFrame:
        return dims.filter(F.col("dim") == dim)

    def rows(df: DataFrame, section: str, item: str, rank: Column | None = None, key: Column | None = None,
             value: Column | None = None, text: Column | None = None) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), F.lit(item).alias("item"),
            (F.lit(None) if rank is None else rank).cast("long").alias("rank"),
            (F.lit(None) if key is None else key).cast("string").alias("key"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"))

    total = part("total").select(F.col("event_count").alias("total_events"), "bots")
    humans = F.col("total_events") - F.col("bots")
    one = total.sparkSession.range(1)
    out = []
    for section in (GLOBAL_SECTION, QUALITY_SECTION, TRAFFIC_SECTION, SYSTEM_SECTION):
        out.append(rows(one, section, "generated_at", text=C.iso_utc(as_of)))
    out.append(rows(one, GLOBAL_SECTION, "report_date", text=F.date_format(as_of, "yyyy-MM-dd")))
    out.append(rows(total, GLOBAL_SECTION, "total_events", value=F.col("total_events")))
    if files_read is not None:
        out.append(rows(files_read, GLOBAL_SECTION, "files_read", value=F.col("files_read")))
    pages = top_n(part("page").select(F.col("k1").alias("title"), F.col("k2").alias("wiki"), "event_count"),
                  S.DAILY_TOP_LIMIT, "event_count", ["title", "wiki"])
    out.append(rows(pages, GLOBAL_SECTION, "top_pages", F.col("rank"), C.page_label("title", "wiki"), F.col("event_count")))
    users = top_n(part("user").select(F.col("k1").alias("user"), "event_count"), S.DAILY_TOP_LIMIT, "event_count", ["user"])
    out.append(rows(users, GLOBAL_SECTION, "top_users", F.col("rank"), F.col("user"), F.col("event_count")))
    out.append(rows(total, GLOBAL_SECTION, "bots", value=F.col("bots")))
    out.append(rows(total, GLOBAL_SECTION, "humans", value=humans))
    out.append(rows(total, GLOBAL_SECTION, "bot_percentage", value=C.pct("bots", "total_events")))

    found = anomalies.agg(F.count(F.lit(1)).alias("n"))
    errors = volumes.filter(F.col("topic") == S.TOPIC_ERRORS).select(F.col("message_count").alias("errors"))
    rate = combine_rows(errors, total.select("total_events"))
    out.append(rows(found, QUALITY_SECTION, "anomalies_detected", value=F.col("n")))
    out.append(rows(errors, QUALITY_SECTION, "ingestion_errors_topic_count", value=F.col("errors")))
    out.append(rows(rate, QUALITY_SECTION, "invalid_events_rate_pct", value=invalid_rate(F.col("errors"), F.col("total_events"))))
    sample = anomaly_sample(anomalies, n_anomalies)
    out.append(rows(sample, QUALITY_SECTION, "anomalies_sample", key=F.col("page"),
                    text=F.concat_ws(" ", "timestamp", "type", "severity", "reason")))

    hours = part("hour").filter(F.col("k1").isNotNull()).select(F.col("k1").alias("hour"), "event_count")
    if n_hours is not None:
        hours = hours.orderBy(F.col("event_count").desc(), "hour").limit(n_hours)
    out.append(rows(hours, TRAFFIC_SECTION, "by_hour", key=F.col("hour"), value=F.col("event_count")))
    for dim in ("language", "wiki"):
        out.append(rows(part(dim), TRAFFIC_SECTION, f"by_{dim}", key=F.col("k1"), value=F.col("event_count")))
    out.append(rows(volumes, TRAFFIC_SECTION, "kafka_topic_volumes", key=F.col("topic"), value=F.col("message_count")))

    if lag is not None:
        out.append(rows(lag.agg(F.coalesce(F.sum("lag"), F.lit(0)).alias("n")), SYSTEM_SECTION, "total_lag", value=F.col("n")))
        out.append(rows(lag, SYSTEM_SECTION, "partition_lag", key=F.concat_ws("/", "topic", F.col("partition").cast("string")), value=F.col("lag")))
    report = out[0]
    for df in out[1:]:
        report = report.unionByName(df)
    return report
