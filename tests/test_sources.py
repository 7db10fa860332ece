"""Lake readers, Kafka decoding and Kafka-shaped output rows."""

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.sinks import writers as W
from recentlake.sources import files as SRC
from recentlake.sources import kafka as K

from conftest import make_events


def test_json_lines_bad_lines_dropped_or_kept(spark, scratch):
    path = os.path.join(scratch, "lines.json")
    good = {"title": "A", "wiki": "enwiki", "ingestion_timestamp": "2024-01-01T00:00:00+00:00"}
    with open(path, "w") as f:
        f.write(json.dumps(good) + "\n\n{broken\n" + json.dumps({**good, "title": "B"}) + "\n")
    assert sorted(r["title"] for r in SRC.read_json_lines(spark, path).collect()) == ["A", "B"]
    kept = SRC.read_json_lines(spark, path, keep_corrupt=True)
    # Spark refuses queries that reference only the corrupt column: read whole rows
    assert sum(1 for r in kept.collect() if r["_corrupt_record"] is not None) == 1


def test_tree_latest_files_and_fallback(spark, scratch):
    root = os.path.join(scratch, "processed")
    ev = make_events(spark, [{"t": i} for i in range(6)])
    for k in range(3):
        ev.filter(F.col("event_id") % 3 == k).coalesce(1).write.json(os.path.join(root, f"part={k}"))
    os.makedirs(os.path.join(root, "_hidden"))
    with open(os.path.join(root, "_hidden", "x.json"), "w") as f:
        f.write('{"title": "hidden"}\n')
    tree = SRC.read_json_tree(spark, root)
    assert tree.count() == 6 and tree.select("source_file").distinct().count() == 3
    last = SRC.latest_files(tree, 1)
    assert last.count() == 2 and last.select("source_file").distinct().first()[0].count("part=2") == 1
    df, used = SRC.read_first_available(spark, [os.path.join(scratch, "missing"), root],
                                        lambda s, p: SRC.read_processed(s, p, fmt="json"))
    assert used == root and df.count() == 6
    assert SRC.load_events(spark, os.path.join(scratch, "nothing")).count() == 0


def test_report_catalogue(spark, scratch):
    W.write_report(spark.range(1).select(F.lit("2024-01-01T00:10:00+00:00").alias("generated_at")),
                   os.path.join(scratch, "r1"))
    cat = {"r1": os.path.join(scratch, "r1"), "r2": os.path.join(scratch, "r2")}
    reports = SRC.load_reports(spark, cat)
    got = {r["name"]: (r["loaded"], r["generated_at"]) for r in reports.collect()}
    assert got == {"r1": (True, "2024-01-01T00:10:00+00:00"), "r2": (False, None)}
    assert SRC.latest_generated_at(reports).first()[0] == datetime(2024, 1, 1, 0, 10)


def opts_of(mode):
    return K.kafka_options("b:9092", S.TOPIC_RAW, mode=mode)


def test_anomaly_history_forms(spark, scratch):
    one = {"type": "spam_heuristic", "page": "P", "severity": "low", "edit_count": 4}
    for name, text in (("doc", json.dumps({"generated_at": "x", "anomalies": [one, {**one, "page": "Q"}]}, indent=1)),
                       ("list", json.dumps([{**one, "page": "R"}])), ("lines", json.dumps({**one, "page": "S"}) + "\n{broken\n"),
                       ("empty", json.dumps({"anomalies": []}))):
        os.makedirs(os.path.join(scratch, "anomalies"), exist_ok=True)
        with open(os.path.join(scratch, "anomalies", f"{name}.json"), "w") as f:
            f.write(text)
    got = SRC.load_anomalies(spark, os.path.join(scratch, "anomalies"))
    assert sorted((r["page"], r["run"], r["edit_count"]) for r in got.collect()) == [
        ("P", "doc", 4), ("Q", "doc", 4), ("R", "list", 4), ("S", "lines", 4)]
    assert SRC.load_anomalies(spark, os.path.join(scratch, "none")).count() == 0


def test_decode_kafka_rows(spark):
    rec = {"title": "T", "wiki": "enwiki", "user": "u", "is_bot": True, "is_anonymous": False,
           "event_type": "edit", "ingestion_timestamp": "2024-01-01T00:00:05+00:00", "source": "s",
           "partition_key": "enwiki", "page_id": 7}
    rows = spark.createDataFrame(
        [(b"enwiki", json.dumps(rec).encode(), S.TOPIC_RAW, 1, 10, datetime(2024, 1, 1)),
         (None, b"not json", S.TOPIC_RAW, 1, 11, datetime(2024, 1, 1))], S.KAFKA_ROW)
    decoded = K.add_event_time(K.decode_kafka(rows)).orderBy("kafka_offset").collect()
    assert decoded[0]["title"] == "T" and decoded[0]["page_id"] == "7" and decoded[0]["kafka_key"] == "enwiki"
    assert decoded[0]["event_time"] == datetime(2024, 1, 1, 0, 0, 5)
    assert decoded[1]["title"] is None and decoded[1]["event_time"] is None
    assert K.json_objects(rows).count() == 1 and K.other_messages(rows).count() == 1
    assert opts_of("replay")["failOnDataLoss"] == "true"
    batch = K.batch_options("b:9092", S.TOPIC_RAW, since_ms=5)
    assert batch["startingTimestamp"] == "5" and "startingOffsets" not in batch
    assert K.batch_options("b:9092", S.TOPIC_RAW)["startingOffsets"] == "earliest"
    opts = K.kafka_options("b:9092", S.TOPIC_RAW, "g", mode="new", max_offsets_per_trigger=100)
    assert opts["startingOffsets"] == "latest" and opts["maxOffsetsPerTrigger"] == "100"


def test_to_kafka_rows(spark):
    df = spark.createDataFrame([("enwiki", "T", S.TOPIC_BOT)], "partition_key string, title string, topic string")
    row = W.to_kafka_rows(df).first()
    assert row["topic"] == S.TOPIC_BOT and row["key"] == "enwiki"
    assert json.loads(row["value"]) == {"partition_key": "enwiki", "title": "T"}
