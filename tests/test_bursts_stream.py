"""Stream bursts equal the batch rules; the ring and the state shrink."""

import os
import random

from conftest import T0, at, make_events
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import anomalies as A
from recentlake.sources import testdata as TD
from recentlake.streaming import bursts as B
from recentlake.streaming import live as LV

BY_ID = ("event_id",)
BURSTS = ("edit_spike", "spam_heuristic")


def _stream(spark, scratch, ev, n_files):
    """Events as ``n_files`` files of consecutive event ids, one a micro-batch."""
    src, schema = os.path.join(scratch, "src"), ev.schema
    size = ev.count() // n_files + 1
    for k in range(n_files):
        ev.where((F.col("event_id") >= k * size) & (F.col("event_id") < (k + 1) * size)).coalesce(1) \
            .write.mode("append").parquet(os.path.join(src, f"f{k:03d}"))
        for name in os.listdir(os.path.join(src, f"f{k:03d}")):
            path = os.path.join(src, f"f{k:03d}", name)
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)


def _run(df, scratch, name):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", os.path.join(scratch, "ck-" + name))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return q, df.sparkSession.table(name)


def _late_and_shuffled(seed, n=700, jitter=400):
    """Bursts over three hours whose order of arrival is off by up to
    ``jitter`` seconds, and one event at the end that closes all runs."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        t, page = rng.uniform(0, 3 * 3600 - 200), rng.choice(["Alpha page", "Beta page", "Gamma page", "x", "", None])
        wiki = rng.choice(["enwiki", "frwiki", None])
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append({"t": round(t + rng.choice([0, rng.uniform(0, 180)]), rng.choice([0, 3])), "title": page,
                         "wiki": wiki, "is_bot": rng.random() < 0.3})
    rows.sort(key=lambda r: r["t"] + rng.uniform(0, jitter))
    rows += [{"t": 12 * 3600, "title": "End of day", "wiki": "enwiki"}, {"t": 12 * 3600 + 1, "title": "End of day", "wiki": "enwiki"}]
    return [{**r, "event_id": i} for i, r in enumerate(rows)]


def _batch_by_run(ev, as_of):
    """Rows of the batch rules over the events of each run."""
    out = []
    for h in range(3):
        part = ev.where((F.col("event_time") >= at(3600 * h)) & (F.col("event_time") < at(3600 * (h + 1))))
        out += [tuple(r) for r in A.detect_anomalies(part, as_of, BY_ID).collect()]
    return out


def test_stream_equals_batch_on_late_shuffled_input(spark, scratch):
    ev = make_events(spark, _late_and_shuffled(3)).cache()
    as_of = F.lit("2024-01-01 01:10:00").cast("timestamp")
    stream = _stream(spark, scratch, ev, 8)
    bursts = B.page_bursts_stream(stream, as_of, "10 minutes", order_cols=BY_ID)
    q, got = _run(bursts, scratch, "bursts_out")
    want = _batch_by_run(ev, as_of)
    rows = sorted((tuple(r) for r in got.drop("run_start").collect()), key=repr)
    reasons = S.ANOMALY_COLUMNS.index("reason")
    assert rows == sorted((r for r in want if r[0] in BURSTS and r[reasons] != S.RULE_SHORT_TITLE), key=repr)
    assert {r[0] for r in rows} == set(BURSTS)
    # all three runs are closed: only the last page's run is left
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) > 5 and held[-1] == 1

    _, events = _run(B.event_hits_stream(stream, as_of, "10 minutes", order_cols=BY_ID), scratch, "event_hits_out")
    kinds = {r[0] for r in want}
    got = sorted((tuple(r) for r in events.drop("run_start").where("timestamp < '2024-01-01T12'").collect()), key=repr)
    assert got == sorted((r for r in want if r[0] == S.ANOMALY_DATA or r[reasons] == S.RULE_SHORT_TITLE), key=repr)
    assert S.ANOMALY_DATA in kinds
    ev.unpersist()


def test_restart_goes_on_with_the_state(spark, scratch):
    rows = _late_and_shuffled(4, 300)
    ev = make_events(spark, rows)
    src, out, ck = (os.path.join(scratch, x) for x in ("src", "out", "ck"))
    as_of = F.lit("2024-01-01 01:10:00").cast("timestamp")
    for k, where in enumerate(("event_id < 150", "event_id >= 150")):
        ev.where(where).coalesce(1).write.mode("append").parquet(src)
        stream = B.page_bursts_stream(spark.readStream.schema(ev.schema).parquet(src), as_of, order_cols=BY_ID)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((tuple(r) for r in spark.read.parquet(out).drop("run_start").collect()), key=repr)
    reasons = S.ANOMALY_COLUMNS.index("reason")
    late = _batch_by_run(ev, as_of)
    assert got == sorted((r for r in late if r[0] in BURSTS and r[reasons] != S.RULE_SHORT_TITLE), key=repr)


def test_ring_is_evicted_by_the_watermark():
    page = B.PageRun()
    t0, minute = int(T0.timestamp() * 1e6), A.MINUTE_US
    times = [t0 + k * 1_000_000 for k in range(1800)]
    random.Random(1).shuffle(times)
    page.add(times, range(1800), [False] * 1800)
    assert len(page.times) == 1800
    page.evict(t0 + 6 * minute)
    assert len(page.times) == 1740 and page.peaks == [[301, t0 + 5 * minute]] and page.rapid == [121, t0 + 2 * minute, False]
    page = B.PageRun(page.saved())
    page.evict(t0 + 60 * minute)
    assert page.times == [] and page.n == 1800 and len(page.peaks) == 1


def test_bot_minutes_complete_the_rules(spark, scratch):
    rows = [{"t": 60 * m + k, "is_bot": True, "title": f"Page {k}"} for m in (1, 3) for k in range(40)] + [{"t": 9000, "is_bot": True}]
    ev = make_events(spark, [{**r, "event_id": i} for i, r in enumerate(rows)])
    _, got = _run(LV.bot_rate_stream(_stream(spark, scratch, ev, 2)), scratch, "bots_out")
    want = A.rule(ev, "bot_high_edit_rate", TD.as_of_col(), BY_ID)
    assert sorted(r.timestamp for r in got.collect()) == sorted(r.timestamp for r in want.collect()) and want.count() == 2
