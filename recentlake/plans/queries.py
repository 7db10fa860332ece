"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the test tables of ``sf_dir`` in full (through the fixture
adapters of ``recentlake.sources.testdata``) and runs one library operator.
Column names equal those of the SQL oracle of the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from recentlake.functions import columns as C
from recentlake.operators import anomalies as A
from recentlake.operators import ingest as I
from recentlake.operators import live as L
from recentlake.operators import monitoring as M
from recentlake.operators import offsets as O
from recentlake.operators import paged as PG
from recentlake.operators import partials as P
from recentlake.operators import reports as R
from recentlake.operators.carried_anomalies import AnomalyState
from recentlake import schema as S
from recentlake.session import checkpoint_root
from recentlake.sinks import writers as W
from recentlake.sinks.page_lake import PageLake
from recentlake.sources import files as SRC
from recentlake.sources import kafka as K
from recentlake.sources import testdata as TD
from recentlake.streaming import bursts as B

Query = Callable[[SparkSession, str], DataFrame]


def _on_events(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(TD.load_processed(spark, sf_dir))

    run.__name__ = getattr(op, "__name__", "query")
    return run


REPORT_QUERIES: dict[str, Query] = {
    "batch_summary": _on_events(R.batch_summary),
    "batch_by_wiki": _on_events(R.batch_by_wiki),
    "activity_by_minute": _on_events(R.activity_by_minute),
    "activity_by_hour": _on_events(R.activity_by_hour),
    "language_distribution": _on_events(R.language_distribution),
    "activity_by_wiki": _on_events(R.activity_by_wiki),
    "top_pages": _on_events(R.top_pages),
    "most_created_pages": _on_events(R.most_created_pages),
    "most_deleted_pages": _on_events(R.most_deleted_pages),
    "top_contributors": _on_events(R.top_contributors),
    "bots_vs_humans": _on_events(R.bots_vs_humans),
    "anonymous_vs_logged": _on_events(R.anonymous_vs_logged),
    "bot_ratio": _on_events(R.bot_ratio),
    "active_bots": _on_events(R.active_bots),
    "daily_global": _on_events(lambda ev: R.daily_global(ev, TD.as_of_col())),
    "daily_top_pages": _on_events(R.daily_top_pages),
    "daily_top_users": _on_events(R.daily_top_users),
    "daily_traffic": _on_events(R.daily_traffic),
}


BY_ID = ("event_id",)  # the fixture's event order


def _rule(name: str) -> Query:
    return _on_events(lambda ev: A.rule(ev, name, TD.as_of_col(), BY_ID))


def _detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.detect_anomalies(TD.load_processed(spark, sf_dir), TD.as_of_col(), BY_ID)


def _anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = TD.load_processed(spark, sf_dir)
    return A.anomaly_report(ev, A.detect_anomalies(ev, TD.as_of_col(), BY_ID), TD.as_of_col())


ANOMALY_QUERIES: dict[str, Query] = {
    "rule_wiki_null": _rule("wiki_null"),
    "rule_unknown_language": _rule("unknown_language"),
    "rule_future_timestamp": _rule("incoherent_timestamp"),
    "rule_short_title": _rule("short_title_repeated"),
    "rule_edit_spike": _rule("edit_spike"),
    "rule_rapid_edits": _rule("rapid_page_edits"),
    "rule_bot_rate": _rule("bot_high_edit_rate"),
    "detect_anomalies": _detect,
    "anomaly_report": _anomaly_report,
}


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.validate_events(TD.load_raw_feed(spark, sf_dir))


def _q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("event_id", "error_reason")


def _q_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = I.enrich_events(_validated(spark, sf_dir), TD.as_of_col(), keep=["event_id", "value"])
    return rec.withColumn("payload_is_line", F.col("payload") == F.col("value")).drop("payload", "value")


def _q_extract_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = I.parse_raw_events(TD.load_raw_feed(spark, sf_dir))
    return I.select_where(parsed, F.col("is_object"), [F.col("event_id"), I.event_wiki().alias("wiki")])


def _q_is_anonymous(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = I.parse_raw_events(TD.load_raw_feed(spark, sf_dir))
    anon = C.is_anonymous("event.anonymous", "event.userid", "event.user").alias("is_anonymous")
    return I.select_where(parsed, F.col("is_object"), [F.col("event_id"), anon])


def _q_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    err = I.error_records(_validated(spark, sf_dir), TD.as_of_col(), keep=["event_id", "value"])
    return err.select("event_id", "error_reason", "partition_key", (F.col("raw_data") == F.col("value")).alias("raw_is_line"),
                      (F.col("partial_event") == F.col("value")).alias("partial_is_line"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest_messages(TD.load_raw_feed(spark, sf_dir), TD.as_of_col(), keep=["event_id"])


def _q_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = I.ingest_messages(TD.load_raw_feed(spark, sf_dir).withColumn("line", F.col("value")), TD.as_of_col(),
                             keep=["event_id", "line"])
    fields = ("title", "wiki", "user", "is_bot", "is_anonymous", "event_type", "page_id", "error_reason")
    # a message is parsed once, in a projection of its own
    parsed = sent.select("event_id", "topic", "key", "line", F.from_json(
        "value", ", ".join(f"{f} string" for f in (*fields, "payload", "raw_data"))).alias("v"))
    return parsed.select("event_id", "topic", "key", *(F.col(f"v.{f}").alias(f"value_{f}") for f in fields),
                         (F.coalesce("v.payload", "v.raw_data") == F.col("line")).alias("value_has_line"))


def _q_decode_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed messages in Kafka's columns, decoded (E1) with event time."""
    rows = _messages(spark, sf_dir).select(
        F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "topic",
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), TD.as_of_col().alias("timestamp"))
    return K.add_event_time(K.decode_kafka(K.json_objects(rows))).select(
        "kafka_key", "kafka_topic", "kafka_offset", "title", "wiki", "user", "is_bot", "is_anonymous", "event_type",
        "ingestion_timestamp", "page_id", F.unix_micros("event_time").alias("event_us"))


def _q_load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as JSON lines with broken lines between them, and
    read back by the lake reader."""
    ev = TD.load_processed(spark, sf_dir)
    line = F.to_json(F.struct(*(f.name for f in S.PROCESSED.fields)), {"timestampFormat": S.JSON_TIME})
    broken = F.when(F.col("event_id") % 7 == 0, F.lit('{"title": "cut')).when(F.col("event_id") % 11 == 0, F.lit("[1]"))
    root = f"{checkpoint_root(spark)}/lake-{uuid.uuid4().hex}"
    ev.select(F.explode(F.filter(F.array(line, broken), lambda x: x.isNotNull()))).write.text(root)
    got = SRC.load_events(spark, root, glob="part-*")
    return got.select(*(f.name for f in S.PROCESSED.fields if f.dataType.typeName() != "timestamp"),
                      F.unix_micros("event_time").alias("event_us"))


def _q_invalid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.validation_counts(_validated(spark, sf_dir))
    return c.select(
        F.col("invalid").alias("ingestion_errors"),
        F.col("valid").alias("total_events"),
        R.invalid_rate(F.col("invalid"), F.col("valid")).alias("invalid_events_rate_pct"),
    )


def _q_topic_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.topic_volumes(I.message_topics(TD.load_raw_feed(spark, sf_dir)))


def _q_missing_page_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 on enriched records (they keep the raw event as ``payload``)."""
    rec = I.enrich_events(_validated(spark, sf_dir), TD.as_of_col(), keep=["event_id"])
    return A.rule(rec, "missing_page_id", TD.as_of_col(), BY_ID)


INGEST_QUERIES: dict[str, Query] = {
    "validate_events": _q_validate,
    "enrich_events": _q_enrich,
    "extract_wiki": _q_extract_wiki,
    "is_anonymous": _q_is_anonymous,
    "error_records": _q_error_records,
    "route_topics": _q_route,
    "invalid_rate": _q_invalid_rate,
    "topic_volumes": _q_topic_volumes,
    "rule_missing_page_id": _q_missing_page_id,
}


def _q_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = TD.duplicated_events(TD.load_processed(spark, sf_dir))
    return L.dedupe_offsets(dup).select("event_id", "kafka_partition", "kafka_offset", "title", "wiki")


def _on_buffer(op: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_events(lambda ev: op(L.live_buffer(ev)))


def _offsets(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    end = M.end_offsets_from(ev)
    done = M.committed_offsets_from(ev, F.col("event_time") <= TD.as_of_col())
    return end, done


def _q_global_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = TD.read_table(spark, sf_dir, "events").withColumn("source_file", F.col("_metadata.file_path"))
    name = F.element_at(F.split("source_path", "/"), -1).alias("source_name")  # folders differ between machines
    return R.global_activity(raw, source_path=f"{sf_dir}/events.parquet").select("total_events", "files_read", name)


def _q_daily_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = TD.load_processed(spark, sf_dir)
    anomalies = A.detect_anomalies(ev, TD.as_of_col(), BY_ID)
    errors = I.error_records(_validated(spark, sf_dir), TD.as_of_col())
    return R.daily_quality(anomalies, errors, ev)


def _q_daily_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = TD.load_processed(spark, sf_dir)
    files = R.global_activity(TD.read_table(spark, sf_dir, "events").withColumn("source_file", F.col("_metadata.file_path")))
    return R.daily_report(ev, TD.as_of_col(), A.detect_anomalies(ev, TD.as_of_col(), BY_ID),
                          I.topic_volumes(I.message_topics(TD.load_raw_feed(spark, sf_dir))), M.offset_lag(*_offsets(ev)), files.select("files_read"))


def _run_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as DAGs, their orders as runs and the line items as task runs."""
    dag = lambda c: F.concat(F.lit("dag_"), F.col(c).cast("string")).alias("dag_id")
    run = lambda c: F.concat(F.lit("run_"), F.col(c).cast("string")).alias("run_id")
    orders = TD.read_table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(
        F.col("o_orderstatus") == "O", F.lit("success")).otherwise(F.lit("running")).alias("state")
    runs = orders.select(dag("o_custkey"), run("o_orderkey"), state, F.col("o_orderdate").cast("timestamp").alias("start_date"),
                         (F.col("o_custkey") % 5 == 0).alias("is_paused"))
    done = F.when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise(F.lit("success")).alias("state")
    items = TD.read_table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"),
                                                          F.col("l_orderkey") == F.col("o_orderkey"))
    tasks = items.select(dag("o_custkey"), run("l_orderkey"), F.col("l_linenumber").cast("string").alias("task_id"), done,
                         F.col("l_quantity").cast("double").alias("duration_sec"), F.lit(1).alias("try_number"))
    return runs, tasks, TD.read_table(spark, sf_dir, "customer").select(dag("c_custkey"))


def _q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_summary(*_run_logs(spark, sf_dir))


def _q_run_monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.run_monitoring(*_run_logs(spark, sf_dir))


def _q_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, _, dags = _run_logs(spark, sf_dir)
    return M.pipeline_failure_rate(runs, dags)


def _own_time(op: Callable[[DataFrame], DataFrame]) -> Query:
    """On the events' own 30 days instead of the compressed hour."""
    return lambda spark, sf_dir: op(TD.load_processed(spark, sf_dir, compression=1))


LIVE_QUERIES: dict[str, Query] = {
    "dedupe_offsets": _q_dedupe,
    "latest_events": _on_events(L.latest_events),
    "latest_event": _on_events(L.latest_event),
    "live_top_pages": _on_buffer(L.live_top_pages),
    "live_by_wiki": _on_buffer(L.live_by_wiki),
    "live_metrics": _on_buffer(L.live_metrics),
    "shorten_title": _on_events(
        lambda ev: ev.select("event_id", C.shorten_title(C.or_default("title", "?")).alias("short_title"))),
    "format_local_time": _on_events(
        lambda ev: ev.select("event_id", C.format_local_time("event_time").alias("local_time"))),
    "data_freshness": _on_events(lambda ev: L.data_freshness(ev, TD.as_of_col())),
    "offset_lag": _on_events(lambda ev: M.offset_lag(*_offsets(ev))),
    "topic_end_volume": _on_events(lambda ev: M.topic_end_volume(_offsets(ev)[0])),
    "global_activity": _q_global_activity,
    "daily_quality": _q_daily_quality,
    "daily_report": _q_daily_report,
    "load_events": _q_load_events,
    "decode_kafka": _q_decode_kafka,
    "run_summary": _q_run_summary,
    "run_monitoring": _q_run_monitoring,
    "pipeline_failure_rate": _q_failure_rate,
    "activity_by_hour_30_days": _own_time(R.activity_by_hour),
    "daily_traffic_30_days": _own_time(R.daily_traffic),
    "daily_traffic_largest": _own_time(lambda ev: R.daily_traffic(ev, S.DAILY_HOURS_LIMIT)),
    "live_bot_share": _on_buffer(L.live_bot_share),
    "newest_keys": _on_events(lambda ev: L.newest_keys(ev, S.LIVE_MAX_EVENTS).toDF("kafka_partition", "kafka_offset", "event_us")),
}


# ---------------------------------------------------------------------------
# Carried state: the same results from what earlier runs left
# ---------------------------------------------------------------------------

def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _placed_before(time: str) -> Column:
    return F.coalesce(F.col("event_time"), TD.as_of_col()) < F.lit(time).cast("timestamp")


def _carried_report(name: str) -> Query:
    """A report from carried counts: the events as a lake of two deliveries,
    counted one after the other."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = TD.load_processed(spark, sf_dir).select(*(f.name for f in S.PROCESSED.fields))
        lake, table = _scratch(spark, "lake"), P.ReportTable(_scratch(spark, "counts"))
        first = _placed_before("2024-01-01 00:30:00")
        for batch, part in (("first", ev.where(first)), ("second", ev.where(~first))):
            part.write.mode("append").parquet(lake)
            table.update(spark, [lake], batch, "parquet", "*.parquet")
        return P.REPORTS[name](table.counts(spark))

    return run


def _anomaly_runs(spark: SparkSession, sf_dir: str) -> AnomalyState:
    """Two anomaly runs, each over the events that the one before had not."""
    ev = TD.load_processed(spark, sf_dir)
    state = AnomalyState(_scratch(spark, "anomaly-state"))
    first = _placed_before("2024-01-01 00:30:30")
    state.update(ev.where(first), TD.as_of_col(), "first", order_cols=BY_ID)
    state.update(ev.where(~first), TD.as_of_col(), "second", ev, BY_ID)
    return state


def _q_anomalies_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomaly_runs(spark, sf_dir).anomalies(spark)


def _q_anomaly_report_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anomaly_runs(spark, sf_dir).report(spark, TD.as_of_col())


def _seen_offsets(spark: SparkSession, ev: DataFrame) -> O.SeenOffsets:
    """Offsets of the events up to the run time, noted as two batches that overlap."""
    seen = O.SeenOffsets(_scratch(spark, "offsets"))
    past = ev.where(F.col("event_time") <= TD.as_of_col())
    seen.add(past.where(_placed_before("2024-01-01 00:30:00")), 0)
    seen.add(past.where(~_placed_before("2024-01-01 00:29:00")), 1)
    return seen


def _q_new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message delivered again: those that the history did not have."""
    ev = TD.load_processed(spark, sf_dir)
    return _seen_offsets(spark, ev).fresh(TD.duplicated_events(ev)).select("event_id", "kafka_partition", "kafka_offset", "title")


def _q_offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.offset_gaps(_seen_offsets(spark, TD.load_processed(spark, sf_dir)).bitmaps(spark))


def _q_offset_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen_offsets(spark, TD.load_processed(spark, sf_dir)).volume(spark)


def _q_stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit spikes and rapid edits found on a stream of the events, in four
    micro-batches; a last event, two hours on, ends the run."""
    ev = TD.load_processed(spark, sf_dir)
    src, out = _scratch(spark, "stream"), _scratch(spark, "bursts")
    quarter = F.coalesce(F.minute("event_time"), F.lit(50)) / 15
    end = spark.range(1).select(F.timestamp_micros(F.lit(TD.EPOCH_US + 3 * 3_600_000_000)).alias("event_time"), F.lit("end").alias("title"))
    for k in range(4):
        ev.where(F.floor(quarter) == k).write.mode("append").parquet(src)
    ev.limit(0).unionByName(end, allowMissingColumns=True).write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    found = B.page_bursts_stream(stream, TD.as_of_col(), order_cols=BY_ID)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(spark, "bursts-log")) \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select(*S.ANOMALY_COLUMNS)


def _q_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, valid and invalid lines, from the write of the messages itself."""
    counts = W.write_messages(TD.load_raw_feed(spark, sf_dir), _scratch(spark, "messages"), "run", TD.as_of_col())
    return spark.createDataFrame([(counts["total"], counts["valid"], counts["invalid"])], "total bigint, valid bigint, invalid bigint")


def _q_missing_page_id_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3 over a Parquet lake whose payload is a VARIANT."""
    lake = _scratch(spark, "variant-lake")
    I.enrich_events(_validated(spark, sf_dir), TD.as_of_col(), keep=["event_id"], variant_payload=True).write.parquet(lake)
    return A.rule(spark.read.parquet(lake), "missing_page_id", TD.as_of_col(), BY_ID)


def _page_lake(spark: SparkSession, sf_dir: str) -> PageLake:
    """The events as a lake bucketed by page, in two batches; pages with over
    200 rows in one are hot."""
    ev = TD.load_processed(spark, sf_dir)
    lake = PageLake(f"page_lake_{uuid.uuid4().hex}", _scratch(spark, "page-lake"), ev.schema, buckets=8, hot_rows=200)
    first = _placed_before("2024-01-01 00:30:00")
    lake.append(ev.where(first), "first")
    lake.append(ev.where(~first), "second")
    return lake


CARRIED_QUERIES: dict[str, Query] = {
    "chart_heads": _on_events(R.chart_heads),
    "top_pages_bucketed": lambda spark, sf_dir: PG.top_pages(spark, _page_lake(spark, sf_dir)),
    "page_rules_bucketed": lambda spark, sf_dir: PG.page_rules(spark, _page_lake(spark, sf_dir), TD.as_of_col(), BY_ID),
    "top_pages_of_many": _on_events(R.top_pages_of_many),
    "ingest_counts": _q_ingest_counts,
    "missing_page_id_variant": _q_missing_page_id_variant,
    **{f"{name}_carried": _carried_report(name) for name in ("activity_by_hour", "top_pages", "active_bots", "bots_vs_humans")},
    "detect_anomalies_carried": _q_anomalies_carried,
    "anomaly_report_carried": _q_anomaly_report_carried,
    "new_messages": _q_new_messages,
    "offset_gaps": _q_offset_gaps,
    "offset_volumes": _q_offset_volumes,
    "stream_bursts": _q_stream_bursts,
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(REPORT_QUERIES)
    out.update(ANOMALY_QUERIES)
    out.update(INGEST_QUERIES)
    out.update(LIVE_QUERIES)
    out.update(CARRIED_QUERIES)
    return out
