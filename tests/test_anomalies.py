"""Anomaly rules on hand-made rows: thresholds, boundaries, dedup order."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from recentlake.operators import anomalies as A

from conftest import T0, make_events

AS_OF_US = int((T0 + timedelta(hours=2)).timestamp() * 1_000_000)


def as_of():
    return F.timestamp_micros(F.lit(AS_OF_US))


def rule(spark, rows, name):
    return A.rule(make_events(spark, rows), name, as_of()).collect()


def test_edit_spike_needs_four_events(spark):
    three = [{"t": 0}, {"t": 10}, {"t": 20}]
    assert rule(spark, three, "edit_spike") == []
    # spread page so baseline is low, then a burst of 3 within 5 minutes
    rows = [{"t": 0}, {"t": 3600}, {"t": 7200 - 200}, {"t": 7200 - 100}, {"t": 7200}]
    got = rule(spark, rows, "edit_spike")
    assert len(got) == 1
    r = got[0]
    assert r["edit_count"] == 3 and r["severity"] == "low" and r["window"] == "5min"
    assert r["timestamp"] == (T0 + timedelta(seconds=7200)).isoformat()
    # baseline = max(1, 5 / 120 min) = 1 -> ratio 3.0
    assert r["ratio_vs_baseline"] == 3.0


def test_edit_spike_closed_interval_and_burst_under_a_minute(spark):
    # exactly 5 minutes apart counts; baseline from span
    rows = [{"t": 0}, {"t": 150}, {"t": 300}, {"t": 4000}]
    got = rule(spark, rows, "edit_spike")
    assert len(got) == 1 and got[0]["edit_count"] == 3
    # all events within one minute: baseline = n, cannot fire
    burst = [{"t": i} for i in range(6)]
    assert rule(spark, burst, "edit_spike") == []


def test_rapid_edits_threshold(spark):
    four = [{"t": i * 30} for i in range(4)]
    assert rule(spark, four, "rapid_page_edits") == []
    five = [{"t": i * 30} for i in range(5)]       # 0..120 s: closed 2-minute window
    got = rule(spark, five, "rapid_page_edits")
    assert len(got) == 1 and got[0]["edit_count"] == 5
    assert got[0]["timestamp"] == (T0 + timedelta(seconds=120)).isoformat()
    spread = [{"t": i * 31} for i in range(5)]      # 124 s span: never 5 in 2 min
    assert rule(spark, spread, "rapid_page_edits") == []


def test_bot_rate_threshold(spark):
    rows = [{"t": i, "is_bot": True, "title": f"p{i}"} for i in range(30)]
    rows += [{"t": 70 + i, "is_bot": True, "title": f"q{i}"} for i in range(29)]
    got = rule(spark, rows, "bot_high_edit_rate")
    assert [(r["timestamp"], r["edits_per_minute"]) for r in got] == [("2024-01-01 00:00:00+00:00", 30)]


def test_data_rules(spark):
    rows = [
        {"wiki": None, "title": "Alpha page"},
        {"wiki": "  ", "title": "Beta page"},
        {"wiki": "unknown", "title": "Gamma page"},
        {"wiki": "unknownwiki", "title": "Delta page"},
        {"wiki": "enwiki", "title": "abc"},
        {"wiki": "enwiki", "title": None, "t": None},
    ]
    ev = make_events(spark, rows)
    got = A.detect_anomalies(ev, as_of()).collect()
    reasons = sorted((r["reason"], r["page"]) for r in got)
    assert ("wiki_null", "Alpha page") in reasons and ("wiki_null", "Beta page") in reasons
    assert ("unknown_language", "Gamma page") in reasons and ("unknown_language", "Delta page") in reasons
    assert ("short_title_repeated", "abc") in reasons
    # missing title: page 'unknown', length 0 fires; missing time -> as_of
    miss = [r for r in got if r["page"] == "unknown"]
    assert miss and miss[0]["timestamp"] == (T0 + timedelta(hours=2)).isoformat()


def test_future_timestamp(spark):
    rows = [{"t": 7200 + 300}, {"t": 7200 + 301, "title": "Later page"}]
    got = rule(spark, rows, "incoherent_timestamp")
    assert [r["page"] for r in got] == ["Later page"]


def test_dedup_short_title_hides_rapid_edit(spark):
    # five edits of a short-titled page within 2 minutes: the rapid-edit hit
    # has the same (type, page, timestamp) as the short-title hit of the
    # last event and comes later, so it is dropped
    rows = [{"t": i * 10, "title": "abc"} for i in range(5)]
    got = A.detect_anomalies(make_events(spark, rows), as_of()).collect()
    at40 = [r for r in got if r["timestamp"] == (T0 + timedelta(seconds=40)).isoformat()]
    assert len(at40) == 1 and at40[0]["reason"] == "short_title_repeated"


def brute_force_page_rules(events):
    """Spec-level check: per page, the first qualifying window, O(n^2)."""
    pages = {}
    for e in events:
        pages.setdefault((e["title"], e["wiki"]), []).append(e["t"])
    spikes, rapid = {}, {}
    for key, ts in pages.items():
        ts = sorted(ts)
        n = len(ts)
        base = max(1, n / max(1, (ts[-1] - ts[0]) / 60))
        for t in ts:
            w = [u for u in ts if t <= u <= t + 300]
            if n >= 4 and len(w) >= 3 and len(w) >= base * 3:
                spikes[key] = (len(w), max(w))
                break
        for t in ts:
            w = [u for u in ts if t <= u <= t + 120]
            if len(w) >= 5:
                rapid[key] = (len(w), max(w))
                break
    return spikes, rapid


def test_page_rules_random_against_brute_force(spark):
    rnd = random.Random(5)
    events = []
    for p in range(12):
        n = rnd.randint(1, 60)
        base = rnd.randint(0, 3000)
        for _ in range(n):
            events.append({"title": f"pagename{p}", "wiki": rnd.choice(["enwiki", "frwiki"]),
                           "t": base + rnd.choice([rnd.randint(0, 900), rnd.randint(0, 20) * 15])})
    df = make_events(spark, events)
    spikes, rapid = brute_force_page_rules(events)
    got_s = {(r["page"], r["wiki"]): (r["edit_count"], r["timestamp"])
             for r in A.rule(df, "edit_spike", as_of()).collect()}
    got_r = {(r["page"], r["wiki"]): (r["edit_count"], r["timestamp"])
             for r in A.rule(df, "rapid_page_edits", as_of()).collect()}
    iso = lambda s: (T0 + timedelta(seconds=s)).isoformat()
    assert got_s == {k: (c, iso(t)) for k, (c, t) in spikes.items()}
    assert got_r == {k: (c, iso(t)) for k, (c, t) in rapid.items()}
