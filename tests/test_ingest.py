"""Validation, enrichment, error records and routing on hand-made lines."""

import json

from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import ingest as I


def lines(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, value string")


GOOD = {"title": " Main ", "wiki": "enwiki", "timestamp": 0, "user": "1.2.3.4", "bot": False, "type": "edit",
        "page_id": 12, "meta": {"domain": "en.example.org", "dt": "2024-01-01T00:00:00Z", "id": "m-1"}}


def test_validation_reasons_in_order(spark):
    vals = [
        "{bad",
        "[1]",
        "null",
        json.dumps({"title": "   ", "wiki": "enwiki", "timestamp": 1}),
        json.dumps({"title": "T", "wiki": "", "server_name": "", "timestamp": 1}),
        json.dumps({"title": "T", "wiki": "", "server_name": "srv.example.org", "timestamp": None}),
        json.dumps({"title": "T", "meta": {"domain": "d.example.org", "dt": "x"}}),
        json.dumps(GOOD),
    ]
    got = [r["error_reason"] for r in I.validate_events(lines(spark, vals)).orderBy("id").collect()]
    assert got == ["invalid_json", "json_not_object", "json_not_object", "missing_or_empty_title",
                   "missing_wiki", "missing_timestamp", None, None]


def test_enrich_fields(spark):
    v = I.validate_events(lines(spark, [json.dumps(GOOD), json.dumps({"title": "X", "server_name": " srvwiki ",
                                                                          "meta": {"dt": "d"}, "bot": True,
                                                                          "type": "Annotate", "userid": 0})]))
    rows = I.enrich_events(v, F.to_timestamp(F.lit("2024-01-01 00:00:00"))).orderBy("title").collect()
    main, x = rows[0], rows[1]
    assert (main["title"], main["wiki"], main["partition_key"], main["page_id"]) == ("Main", "enwiki", "enwiki", "12")
    assert main["is_anonymous"] is True and main["is_bot"] is False and main["user"] == "1.2.3.4"
    assert main["ingestion_timestamp"] == "2024-01-01T00:00:00+00:00" and main["source"] == S.DEFAULT_SOURCE
    assert (x["wiki"], x["partition_key"], x["user"], x["event_type"]) == (" srvwiki ", "srvwiki", "unknown", "Annotate")
    assert x["is_anonymous"] is True and x["page_id"] is None


def test_routing_and_errors(spark):
    vals = [json.dumps(GOOD), json.dumps({**GOOD, "bot": True}), json.dumps({**GOOD, "type": "log"}),
            "{bad", json.dumps({"title": "", "wiki": "frwiki"})]
    msgs = I.ingest_messages(lines(spark, vals), F.current_timestamp(), keep=["id"]).collect()
    by_id = {}
    for m in msgs:
        by_id.setdefault(m["id"], []).append((m["topic"], m["key"]))
    assert sorted(by_id[0]) == [(S.TOPIC_EDITS, "enwiki"), (S.TOPIC_RAW, "enwiki")]
    assert sorted(by_id[1]) == sorted([(S.TOPIC_RAW, "enwiki"), (S.TOPIC_BOT, "enwiki"), (S.TOPIC_EDITS, "enwiki")])
    assert by_id[2] == [(S.TOPIC_RAW, "enwiki")]
    assert by_id[3] == [(S.TOPIC_ERRORS, "unknown")]
    assert by_id[4] == [(S.TOPIC_ERRORS, "frwiki")]
    long = I.validate_events(lines(spark, ["x" * 2500]))
    err = I.error_records(long, F.current_timestamp()).first()
    assert err["error_reason"] == "invalid_json" and len(err["raw_data"]) == 2500 and err["partial_event"] is None
    cut = I.error_records(long, F.current_timestamp(), raw_max_chars=S.RAW_DATA_MAX_CHARS).first()
    assert len(cut["raw_data"]) == 2000


def test_flags_by_json_type_and_repeated_keys(spark):
    base = {k: v for k, v in GOOD.items() if k not in ("bot", "user")}
    cases = [({"bot": "false"}, True, False), ({"bot": ""}, False, False), ({"bot": 0}, False, False), ({"bot": 2}, True, False),
             ({"bot": None}, False, False), ({"bot": []}, False, False), ({"bot": [0]}, True, False), ({}, False, False),
             ({"anonymous": "true"}, False, False), ({"anonymous": 1}, False, False), ({"anonymous": True}, False, True),
             ({"userid": "0"}, False, False), ({"userid": 0}, False, True), ({"userid": 0.0}, False, True),
             ({"userid": 0.5}, False, False), ({"userid": False}, False, True), ({"userid": 7}, False, False)]
    v = I.validate_events(lines(spark, [json.dumps({**base, **c}) for c, _, _ in cases]))
    got = {r["id"]: (r["is_bot"], r["is_anonymous"]) for r in I.enrich_events(v, keep=["id"]).collect()}
    assert [got[k] for k in range(len(cases))] == [(b, a) for _, b, a in cases]
    twice = I.enrich_events(I.validate_events(lines(spark, ['{"title":"A","title":"B","wiki":"w","timestamp":1}']))).first()
    assert twice["title"] == "B"


def test_bounded_batch(spark):
    raw = lines(spark, [json.dumps(GOOD)] * 5)
    assert I.bounded_batch(raw, 3).count() == 3 and I.bounded_batch(raw, None).count() == 5


def test_topic_volumes_include_empty_topics(spark):
    msgs = I.ingest_messages(lines(spark, [json.dumps(GOOD)]), F.current_timestamp())
    got = {r["topic"]: r["message_count"] for r in I.topic_volumes(msgs).collect()}
    assert got == {S.TOPIC_RAW: 1, S.TOPIC_BOT: 0, S.TOPIC_EDITS: 1, S.TOPIC_ERRORS: 0}
    capped = {r["topic"]: r["message_count"] for r in I.topic_volumes(msgs, cap=0).collect()}
    assert set(capped.values()) == {0}
