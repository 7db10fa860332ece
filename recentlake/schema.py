"""Schemas and fixed values shared by all operators.

Fixed values: these must stay exactly as written for results to match the
studied pipeline's reports (topic names, type sets, rule thresholds, labels).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied pipeline's; do not edit)
# ---------------------------------------------------------------------------
TOPIC_RAW = "wm.recentchange.raw"
TOPIC_BOT = "wm.bot.events"
TOPIC_EDITS = "wm.page.edits"
TOPIC_ERRORS = "wm.errors"
TOPICS = (TOPIC_RAW, TOPIC_BOT, TOPIC_EDITS, TOPIC_ERRORS)

CREATE_TYPES = ("new", "create")
DELETE_TYPES = ("delete", "remove")
EDIT_TYPES = ("edit", "annotate")

EDIT_SPIKE_RATIO = 3.0
EDIT_SPIKE_WINDOW_MIN = 5
EDIT_SPIKE_MIN_EVENTS = 4
EDIT_SPIKE_MIN_IN_WINDOW = 3
BOT_EDITS_PER_MIN_THRESHOLD = 30
SPAM_EDITS_IN_WINDOW = 5
SPAM_WINDOW_MIN = 2
SHORT_TITLE_LEN = 5
FUTURE_TOLERANCE_MIN = 5
SEVERITY_HIGH_AT = 10
SEVERITY_MEDIUM_AT = 5

TOP_LIMIT = 20          # top pages / contributors / bots
DAILY_TOP_LIMIT = 10    # daily report top pages / users
DAILY_HOURS_LIMIT = 48  # daily report hourly buckets
ANOMALY_SAMPLE = 20     # daily report stored anomalies shown
# charts: entries shown of each section
CHART_HEADS = {"minute": 60, "hour": 48, "language": 15, "wiki": 15, "page": 15, "user": 15, "bot": 15}
LIVE_MAX_EVENTS = 1000  # live buffer size
LIVE_TOP_N = 15         # live top pages / wikis
LIVE_TABLE_ROWS = 30    # live latest-events table
TITLE_MAX_LEN = 50      # live chart title shortening
FRESHNESS_MINUTES = 10
STALE_SECONDS = 30
RAW_DATA_MAX_CHARS = 2000  # of the studied error records (an option here)

UNKNOWN = "unknown"
UNKNOWN_BOT = "unknown_bot"
LIVE_MISSING = "?"
INVALID_TIME_LABEL = "timestamp invalide"
LOCAL_TZ = "Europe/Paris"
LOCAL_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
IPV4_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$"

REASON_INVALID_JSON = "invalid_json"
REASON_NOT_OBJECT = "json_not_object"
REASON_NO_TITLE = "missing_or_empty_title"
REASON_NO_WIKI = "missing_wiki"
REASON_NO_TIMESTAMP = "missing_timestamp"

ANOMALY_DATA = "data_anomaly"
ANOMALY_SPAM = "spam_heuristic"
ANOMALY_SPIKE = "edit_spike"
ANOMALY_BOT = "bot_behavior_anomaly"
BOT_PAGE_LABEL = "multiple"
RULE_WIKI_NULL = "wiki_null"
RULE_UNKNOWN_LANGUAGE = "unknown_language"
RULE_MISSING_PAGE_ID = "missing_page_id"
RULE_FUTURE_TIME = "incoherent_timestamp"
RULE_SHORT_TITLE = "short_title_repeated"
RULE_RAPID_EDITS = "rapid_page_edits"
RULE_BOT_RATE = "bot_high_edit_rate"
SEVERITY_HIGH = "high"
SEVERITY_MEDIUM = "medium"
SEVERITY_LOW = "low"

# Times in JSON files keep their microseconds.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Report folders of the lake.
REPORT_ZONES = ("top_pages", "users", "bots", "global", "monitoring")
# Columns that a decoded message gets from the broker.
KAFKA_COLUMNS = ("kafka_key", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")

# Value written in the `source` field of enriched records.
DEFAULT_SOURCE = "recentchange-feed"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# Enriched ("valid") record as published to the topics.
VALID_RECORD = T.StructType(
    [
        T.StructField("ingestion_timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("is_anonymous", T.BooleanType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("page_id", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)

# The record fields the stream job decodes (payload is not carried on).
STREAM_RECORD = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("is_bot", T.BooleanType()),
        T.StructField("is_anonymous", T.BooleanType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("ingestion_timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("page_id", T.StringType()),
    ]
)

ERROR_RECORD = T.StructType(
    [
        T.StructField("ingestion_timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("error_reason", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("partial_event", T.StringType()),
    ]
)

# Processed event: Kafka metadata + record fields + parsed event time.
PROCESSED = T.StructType(
    [
        T.StructField("kafka_key", T.StringType()),
        T.StructField("kafka_topic", T.StringType()),
        T.StructField("kafka_partition", T.IntegerType()),
        T.StructField("kafka_offset", T.LongType()),
        T.StructField("kafka_timestamp", T.TimestampType()),
        *STREAM_RECORD.fields,
        T.StructField("event_time", T.TimestampType()),
    ]
)

# Kafka source rows (what spark.readStream.format("kafka") yields).
KAFKA_ROW = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# Flat anomaly row: one column per detail key, null where a rule has none.
ANOMALY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ingestion_timestamp", T.StringType()),
        T.StructField("edit_count", T.LongType()),
        T.StructField("window", T.StringType()),
        T.StructField("ratio_vs_baseline", T.DoubleType()),
        T.StructField("edits_per_minute", T.LongType()),
        T.StructField("threshold", T.LongType()),
    ]
)
ANOMALY_COLUMNS = [f.name for f in ANOMALY.fields]

# Run-log tables (scheduler monitoring).
RUNS = T.StructType(
    [
        T.StructField("dag_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("start_date", T.TimestampType()),
        T.StructField("is_paused", T.BooleanType()),
    ]
)
TASK_RUNS = T.StructType(
    [
        T.StructField("dag_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("try_number", T.IntegerType()),
    ]
)
