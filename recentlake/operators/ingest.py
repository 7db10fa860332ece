"""Feed ingestion: parse, validate, enrich, route.

Input is a DataFrame with one raw JSON text per row (``value``), from a text
file, a Kafka topic or a stream.  Everything here is a narrow projection:
one JSON parse per line (VARIANT), no shuffle, so it runs at scan speed and
is identical in batch and Structured Streaming.

  parse_raw_events   value -> event struct (typed fields), json_ok, is_object
  validate_events    + error_reason (first failing check, null when valid)
  enrich_events      valid rows -> enriched record columns
  error_records      invalid rows -> error record columns
  route_topics       record -> 1..3 (topic, key, value) messages
  ingest_messages    all of the above: every message for every input line
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.session import ensure_session_conf


def _get(v: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(v, path, dtype)


def _json(v: Column, path: str) -> Column:
    """JSON text of a field, which also tells its type; null when missing."""
    return F.to_json(F.try_variant_get(v, path, "variant"))


def truthy(text: Column) -> Column:
    """Truth of a JSON value given as JSON text: non-empty text (also
    ``"false"``), a number other than 0, a non-empty list or object, or true."""
    return (
        F.when(text.isin("true", "false", "null", '""', "{}", "[]"), text == "true")
        .when(text.rlike(r'^["\[{]'), F.lit(True))
        .otherwise(text.try_cast("double") != 0.0)
    )


def is_json_true(text: Column) -> Column:
    """The value is the boolean true, nothing like it."""
    return text == "true"


def whole_number(text: Column) -> Column:
    """The value of a whole JSON number (false is 0, true is 1); null for text
    and anything else."""
    value = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(value == F.floor(value), value.cast("long"))


def parse_raw_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse each line once; extract the fields the pipeline reads.

    Adds ``json_ok`` (valid JSON), ``is_object`` (top level is an object) and
    ``event`` (the fields the pipeline reads).  Blank lines should be
    removed before (``sources.read_raw_events`` does).  Number-valued string
    fields come back as their JSON text (``12`` -> ``'12'``).
    """
    ensure_session_conf(raw.sparkSession)
    text = F.col(value_col)
    # The parse gets its own projection: CollapseProject does not copy a
    # costly expression into several consumers, so each line parses once.
    parsed = raw.select("*", F.try_parse_json(text).alias("_json"))
    # So do the fields of any type, which are looked at more than once.
    parsed = parsed.select("*", *(_json(F.col("_json"), f"$.{f}").alias(f"_{f}") for f in ("bot", "anonymous", "userid")))
    v = F.col("_json")
    ev = F.struct(
        _get(v, "$.title", "string").alias("title"),
        _get(v, "$.wiki", "string").alias("wiki"),
        _get(v, "$.server_name", "string").alias("server_name"),
        _get(v, "$.timestamp", "string").alias("timestamp"),
        _get(v, "$.user", "string").alias("user"),
        whole_number(F.col("_userid")).alias("userid"),
        truthy(F.col("_bot")).alias("bot"),
        is_json_true(F.col("_anonymous")).alias("anonymous"),
        _get(v, "$.type", "string").alias("type"),
        _get(v, "$.page_id", "string").alias("page_id"),
        F.struct(
            _get(v, "$.meta.domain", "string").alias("domain"),
            _get(v, "$.meta.dt", "string").alias("dt"),
            _get(v, "$.meta.id", "string").alias("id"),
        ).alias("meta"),
    )
    ok = v.isNotNull()
    return parsed.select(
        *[F.col(c) for c in raw.columns],
        ok.alias("json_ok"),
        (ok & C.is_json_object_text(text)).alias("is_object"),
        ev.alias("event"),
        "_json",
    )


def event_wiki(event: str = "event") -> Column:
    return C.extract_wiki(f"{event}.wiki", f"{event}.server_name", f"{event}.meta.domain")


def validate_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parsed events plus ``error_reason`` (ordered checks, first failure)."""
    parsed = raw if "event" in raw.columns else parse_raw_events(raw, value_col)
    reason = (
        F.when(~F.col("json_ok"), F.lit(S.REASON_INVALID_JSON))
        .when(~F.col("is_object"), F.lit(S.REASON_NOT_OBJECT))
        .when(C.clean_title("event.title").isNull(), F.lit(S.REASON_NO_TITLE))
        .when(event_wiki().isNull(), F.lit(S.REASON_NO_WIKI))
        .when(C.extract_event_ts("event.timestamp", "event.meta.dt").isNull(), F.lit(S.REASON_NO_TIMESTAMP))
    )
    return parsed.withColumn("error_reason", reason)


def select_where(df: DataFrame, cond: Column, cols: list[Column]) -> DataFrame:
    """``df.filter(cond).select(cols)`` that keeps ``cond`` above the parse.

    A plain filter on ``error_reason`` is pushed beneath the projection that
    parses the JSON, and the parse is then inlined into the filter: every
    line would be parsed once for the test and again for the output.  Rows
    are instead kept through a generator of zero or one element, which the
    optimizer does not push through, so each line is parsed exactly once.
    """
    one = F.filter(F.array(F.when(cond, F.struct(*cols))), lambda x: x.isNotNull())
    return df.select(F.explode(one).alias("_r")).select("_r.*")


def validation_counts(validated: DataFrame) -> DataFrame:
    """One row: total, valid, invalid."""
    return validated.agg(*count_columns())


def count_columns() -> list[Column]:
    """total, valid, invalid of validated lines."""
    bad = F.col("error_reason").isNotNull()
    return [F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid")]


def observed(validated: DataFrame, name: Observation | str) -> DataFrame:
    """``validated`` whose counts are taken as its rows go by (F2): no pass of
    their own.  With an ``Observation`` a batch action fills them in; with a
    name they are in the progress reports of a stream."""
    return validated.observe(name, *count_columns())


def record_columns(ingestion_ts: Column, source: str = S.DEFAULT_SOURCE, value_col: str = "value") -> list[Column]:
    """Enriched record fields (``schema.VALID_RECORD``) from a parsed event."""
    wiki = F.coalesce(event_wiki(), F.lit(S.UNKNOWN))
    return [
        C.iso_utc(ingestion_ts).alias("ingestion_timestamp"),
        F.lit(source).alias("source"),
        C.partition_key(wiki).alias("partition_key"),
        C.is_true("event.bot").alias("is_bot"),
        C.is_anonymous("event.anonymous", "event.userid", "event.user").alias("is_anonymous"),
        F.coalesce(F.col("event.type"), F.lit(S.UNKNOWN)).alias("event_type"),
        wiki.alias("wiki"),
        F.coalesce(C.clean_title("event.title"), F.lit(S.UNKNOWN)).alias("title"),
        C.user_or_unknown("event.user").alias("user"),
        C.page_id_fallback("event.page_id", "event.meta.id").alias("page_id"),
        F.col(value_col).alias("payload"),
    ]


RECORD_FIELDS = [f.name for f in S.VALID_RECORD.fields]
ERROR_FIELDS = [f.name for f in S.ERROR_RECORD.fields]


def enrich_events(validated: DataFrame, ingestion_ts: Column | None = None, source: str = S.DEFAULT_SOURCE,
                  keep: list[str] | None = None, value_col: str = "value", variant_payload: bool = False) -> DataFrame:
    """Valid rows -> enriched records (plus ``keep`` pass-through columns).

    With ``variant_payload`` the payload is the parsed line as a VARIANT, which
    Parquet stores as such: rules read its fields without parsing text again."""
    ts = ingestion_ts if ingestion_ts is not None else F.current_timestamp()
    cols = [F.col(c) for c in (keep or [])] + record_columns(ts, source, value_col)
    if variant_payload:
        cols[-1] = F.col("_json").alias("payload")
    return select_where(validated, F.col("error_reason").isNull(), cols)


def error_columns(ingestion_ts: Column, source: str = S.DEFAULT_SOURCE, value_col: str = "value",
                  raw_max_chars: int | None = None) -> list[Column]:
    """``raw_data`` is the whole line, or its first ``raw_max_chars``."""
    raw = F.col(value_col) if raw_max_chars is None else F.substring(F.col(value_col), 1, raw_max_chars)
    reason = F.col("error_reason")
    unparsed = reason.isin(S.REASON_INVALID_JSON, S.REASON_NOT_OBJECT)
    wiki = F.when(unparsed, F.lit(None).cast("string")).otherwise(event_wiki())
    return [
        C.iso_utc(ingestion_ts).alias("ingestion_timestamp"),
        F.lit(source).alias("source"),
        F.coalesce(C.partition_key(wiki), F.lit(S.UNKNOWN)).alias("partition_key"),
        reason.alias("error_reason"),
        raw.alias("raw_data"),
        F.when(unparsed, F.lit(None).cast("string")).otherwise(F.col(value_col)).alias("partial_event"),
    ]


def error_records(validated: DataFrame, ingestion_ts: Column | None = None, source: str = S.DEFAULT_SOURCE,
                  keep: list[str] | None = None, value_col: str = "value",
                  raw_max_chars: int | None = None) -> DataFrame:
    ts = ingestion_ts if ingestion_ts is not None else F.current_timestamp()
    cols = [F.col(c) for c in (keep or [])] + error_columns(ts, source, value_col, raw_max_chars)
    return select_where(validated, F.col("error_reason").isNotNull(), cols)


def topics_for(is_bot: Column, event_type: Column) -> Column:
    """raw always; bot topic when is_bot; edits topic for edit/annotate."""
    arr = F.array(
        F.lit(S.TOPIC_RAW),
        F.when(C.is_true(is_bot), F.lit(S.TOPIC_BOT)),
        F.when(C.is_edit(event_type), F.lit(S.TOPIC_EDITS)),
    )
    return F.filter(arr, lambda x: x.isNotNull())


def _per_topic(rows: DataFrame, topics: Column, key: Column, value: Column, keep: list[str] | None) -> DataFrame:
    """One row per topic.  Key and value are made once for each input row: a
    generator of one element keeps the optimizer from copying them."""
    one = F.filter(F.array(F.struct(topics.alias("topics"), key.alias("key"), value.alias("value"))),
                   lambda m: F.size(m["topics"]) > 0)
    made = rows.select(*(keep or []), F.explode(one).alias("_m"))
    return made.select(*(keep or []), F.explode("_m.topics").alias("topic"), F.col("_m.key").alias("key"),
                       F.col("_m.value").alias("value"))


def route_topics(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Enriched records -> one message per target topic: topic, key, value."""
    value = F.to_json(F.struct(*[F.col(c) for c in RECORD_FIELDS]))
    return _per_topic(records, topics_for(F.col("is_bot"), F.col("event_type")), F.col("partition_key"), value, keep)


def ingest_messages(raw: DataFrame, ingestion_ts: Column | None = None, source: str = S.DEFAULT_SOURCE,
                    keep: list[str] | None = None, value_col: str = "value") -> DataFrame:
    """Every outgoing message for every raw line, in one pass.

    Valid lines give 1..3 messages (raw / bot / edits topics), invalid lines
    one message on the errors topic.  ``raw`` may already be validated.  Output ``topic, key, value`` is the
    shape of a Kafka sink; nothing is shuffled.
    """
    ts = ingestion_ts if ingestion_ts is not None else F.current_timestamp()
    v = raw if "error_reason" in raw.columns else validate_events(raw, value_col)
    valid = v.error_reason.isNull()
    rec = F.struct(*record_columns(ts, source, value_col))
    err = F.struct(*error_columns(ts, source, value_col))
    topics = F.when(valid, topics_for(rec["is_bot"], rec["event_type"])).otherwise(
        F.array(F.lit(S.TOPIC_ERRORS))
    )
    key = F.when(valid, rec["partition_key"]).otherwise(err["partition_key"])
    value = F.when(valid, F.to_json(rec)).otherwise(F.to_json(err))
    return _per_topic(v, topics, key, value, keep)


def message_topics(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """``topic`` of every message that ``ingest_messages`` makes, without
    making keys and values: enough to count them."""
    v = raw if "error_reason" in raw.columns else validate_events(raw, value_col)
    topics = F.when(v.error_reason.isNull(), topics_for(F.col("event.bot"), F.col("event.type"))).otherwise(
        F.array(F.lit(S.TOPIC_ERRORS)))
    return v.select(F.explode(topics).alias("topic"))


def topic_volumes(messages: DataFrame, cap: int | None = None) -> DataFrame:
    """Messages per known topic (zero when none); optional per-topic cap.

    The four topic names form a fixed 4-row table joined to the 4-row
    aggregate, so this costs one scan and one tiny shuffle.
    """
    spark = messages.sparkSession
    names = spark.createDataFrame([(t,) for t in S.TOPICS], "topic string")
    # at most len(TOPICS) rows by construction: safe to broadcast
    counts = messages.filter(F.col("topic").isin(*S.TOPICS)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    if cap is not None:
        n = F.least(n, F.lit(cap).cast("long"))
    return names.join(F.broadcast(counts), "topic", "left").select("topic", n.alias("message_count"))


def bounded_batch(raw: DataFrame, max_events: int | None) -> DataFrame:
    """At most ``max_events`` raw lines (valid and invalid together).

    The bounded ingestion run of the studied pipeline ("stop after N
    events"): a limit is the feature here.  Streaming jobs bound each
    micro-batch with ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger`` and
    ``trigger(availableNow=True)`` instead.
    """
    return raw if not max_events else raw.limit(max_events)
