"""Runs over new events with carried state equal one run over all events."""

import os
import random

import pytest
from conftest import make_events
from pyspark.sql import functions as F

from recentlake.operators import anomalies as A
from recentlake.operators.carried_anomalies import AnomalyState
from recentlake.sources import testdata as TD

SF = "/root/testdata/sf0.001"
BY_ID = ("event_id",)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _bursty(seed, n=500, hours=1.0):
    """Events of a few pages with bursts, ties, bots and short titles."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        t, page = rng.uniform(0, 3600 * hours), rng.choice(["Alpha page", "Beta page", "Gamma", "Delta page", "x", None])
        wiki = rng.choice(["enwiki", "frwiki", None])
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            rows.append({"t": round(t + rng.choice([0, rng.uniform(0, 150)]), rng.choice([0, 3])), "title": page, "wiki": wiki,
                         "is_bot": rng.random() < 0.5})
    return rows[:n]


@pytest.mark.parametrize("parts", [2, 4])
def test_runs_in_time_order_equal_one_run(spark, scratch, parts):
    rows = sorted(_bursty(1), key=lambda r: r["t"])
    ev = make_events(spark, [{**r, "event_id": i} for i, r in enumerate(rows)])
    state = AnomalyState(os.path.join(scratch, "state"))
    for k in range(parts):
        part = ev.where((F.col("event_id") * parts / len(rows)).cast("int") == k)
        assert state.update(part, TD.as_of_col(), f"run{k}", order_cols=BY_ID)
        sofar = ev.where((F.col("event_id") * parts / len(rows)).cast("int") <= k)
        assert _rows(state.anomalies(spark)) == _rows(A.detect_anomalies(sofar, TD.as_of_col(), BY_ID))
    assert {r.reason or r.type for r in state.anomalies(spark).collect()} >= {"edit_spike", "rapid_page_edits", "short_title_repeated"}
    assert not state.update(ev, TD.as_of_col(), "run0", order_cols=BY_ID)  # a repeated run adds nothing
    report = state.report(spark, TD.as_of_col()).first()
    assert report == A.anomaly_report(ev, A.detect_anomalies(ev, TD.as_of_col(), BY_ID), TD.as_of_col()).first()


def test_late_events_need_the_history_of_their_pages_only(spark, scratch):
    rows = _bursty(2, 400)
    ev = make_events(spark, [{**r, "event_id": i} for i, r in enumerate(rows)]).cache()
    state = AnomalyState(os.path.join(scratch, "state"))
    for k in range(3):  # parts by order, not by time: most pages get late events
        sofar = ev.where(F.col("event_id") < (k + 1) * 140)
        part = sofar.where(F.col("event_id") >= k * 140)
        if k == 1:
            with pytest.raises(ValueError, match="history"):
                state.update(part, TD.as_of_col(), "early", order_cols=BY_ID)
        state.update(part, TD.as_of_col(), f"run{k}", sofar, BY_ID)
        assert _rows(state.anomalies(spark)) == _rows(A.detect_anomalies(sofar, TD.as_of_col(), BY_ID))
    ev.unpersist()


def test_two_halves_of_the_test_table(spark, scratch):
    ev = TD.load_processed(spark, SF)
    state = AnomalyState(os.path.join(scratch, "state"))
    cut = F.coalesce(F.col("event_time"), TD.as_of_col()) < F.lit("2024-01-01 00:30:30").cast("timestamp")
    state.update(ev.where(cut), TD.as_of_col(), "a", order_cols=BY_ID)
    state.update(ev.where(~cut), TD.as_of_col(), "b", order_cols=BY_ID)
    assert _rows(state.anomalies(spark)) == _rows(A.detect_anomalies(ev, TD.as_of_col(), BY_ID))


def test_empty_runs(spark, scratch):
    state = AnomalyState(os.path.join(scratch, "state"))
    assert state.anomalies(spark).count() == 0
    none = make_events(spark, [{"t": 0}]).limit(0)
    assert state.update(none, TD.as_of_col(), "a", order_cols=BY_ID)
    assert state.anomalies(spark).count() == 0 and state.report(spark, TD.as_of_col()).first()["events_analyzed"] == 0
