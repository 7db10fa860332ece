"""The lake bucketed by page: rows, plans without an exchange, dead runs, replays."""

import os
import random
import uuid

import pytest
from conftest import make_events
from pyspark.sql import functions as F

from recentlake.operators import anomalies as A
from recentlake.operators import paged as PG
from recentlake.operators import reports as R
from recentlake.operators.windows import forward_window_stats, key_window_stats
from recentlake.sinks.page_lake import PAGE, PageLake

BY_ID = ("event_id",)


def as_of():
    return F.lit("2024-01-01 02:00:00").cast("timestamp")


def some_events(spark, n=600, seed=3, start=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        title = rnd.choice(["hot", "hot", "hot", None, "", "a", "b", f"p{rnd.randrange(40)}"])
        rows.append({"event_id": start + i, "title": title, "wiki": rnd.choice(["enwiki", None, ""]) if title != "hot" else "enwiki",
                     "t": rnd.choice([None, *range(0, 3000, 7)])})
    return make_events(spark, rows)


def new_lake(spark, scratch, events, **options):
    return PageLake(f"lake_{uuid.uuid4().hex}", os.path.join(scratch, "lake"), events.schema, buckets=4, **options)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_key_window_stats_equal_the_sliced_form(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), rnd.choice([rnd.randint(0, 900), 30 * rnd.randint(0, 20)]), rnd.randint(0, 99)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, s long")
    widths = {"one": 10, "six": 60}
    got = key_window_stats(df, ["k"], "t", widths, carry_min="s")
    want = forward_window_stats(df, ["k"], "t", widths, slice_us=10, carry_min="s")
    assert rows_of(got.select(*want.columns)) == rows_of(want)


def test_batches_hold_all_rows_and_a_page_lies_in_one_table(spark, scratch):
    first, second = some_events(spark), some_events(spark, 500, 4, 1000)
    lake = new_lake(spark, scratch, first, hot_rows=100)
    assert lake.append(first, 0) and lake.append(second, 1)
    both = first.unionByName(second)
    assert rows_of(lake.events(spark)) == rows_of(both)
    hot = {tuple(r) for r in lake.hot(spark).select(*PAGE).distinct().collect()}
    assert ("hot", "enwiki") in hot
    assert not hot & {tuple(r) for r in lake.pages(spark).select(*PAGE).distinct().collect()}
    assert rows_of(PG.top_pages(spark, lake)) == rows_of(R.top_pages(both))
    for name in A.PAGE_RULES:
        got = PG.page_rules(spark, lake, as_of(), BY_ID, [name])
        assert got.count() and rows_of(got) == rows_of(A.rule(both, name, as_of(), BY_ID))


def test_a_page_that_grows_stays_in_its_bucket(spark, scratch):
    small = make_events(spark, [{"event_id": i, "title": "p", "t": i} for i in range(5)])
    large = make_events(spark, [{"event_id": 10 + i, "title": "p", "t": 10 + i} for i in range(50)])
    lake = new_lake(spark, scratch, small, hot_rows=20)
    lake.append(small, 0)
    lake.append(large, 1)
    assert lake.hot(spark).count() == 0 and lake.pages(spark).count() == 55
    again = PageLake(f"lake_{uuid.uuid4().hex}", os.path.join(scratch, "again"), small.schema, buckets=4, hot_rows=20)
    again.append(lake.events(spark), 0)  # written anew: decided again
    assert again.hot(spark).count() == 55 and again.pages(spark).count() == 0
    again.append(small, 1)  # a known hot page stays hot
    assert again.hot(spark).count() == 60


def test_no_exchange_of_bucketed_rows(spark, scratch):
    events = some_events(spark)
    lake = new_lake(spark, scratch, events, hot_rows=100)
    lake.append(events, 0)
    lake.append(some_events(spark, 300, 5, 1000), 1)
    windows = PG.page_windows(lake.pages(spark), as_of(), BY_ID, True)
    for df in (A.page_hits(windows), lake.pages(spark).groupBy(*PAGE).agg(F.count(F.lit(1)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange" not in plan
    assert "Exchange" in A.page_hits(PG.page_windows(lake.hot(spark), as_of(), BY_ID, False))._jdf.queryExecution().executedPlan().toString()


def test_replays_and_dead_runs_add_nothing(spark, scratch, monkeypatch):
    events = some_events(spark, 200)
    lake = new_lake(spark, scratch, events, hot_rows=50)
    assert lake.append(events, "run") and not lake.append(events, "run")

    def die(*args, **kwargs):
        raise RuntimeError("killed")

    more = some_events(spark, 100, 8, 1000)
    with monkeypatch.context() as m:
        m.setattr(lake.log, "publish", die)
        with pytest.raises(RuntimeError):
            lake.append(more, "next")
    assert spark.table(lake.name).count() > lake.pages(spark).count()  # its rows lie there, unread
    assert rows_of(lake.events(spark)) == rows_of(events)
    assert lake.append(more, "next")
    assert rows_of(lake.events(spark)) == rows_of(events.unionByName(more))


def test_another_catalog_registers_the_files(spark, scratch):
    events = some_events(spark, 200)
    lake = new_lake(spark, scratch, events, hot_rows=50)
    lake.append(events, 0)
    other = PageLake(f"lake_{uuid.uuid4().hex}", lake.root, events.schema, buckets=4, hot_rows=50)
    assert rows_of(other.events(spark)) == rows_of(events)
    assert "Bucketed: true" in other.pages(spark).groupBy(*PAGE).count()._jdf.queryExecution().executedPlan().toString()


def test_empty_lake_and_empty_batch(spark, scratch):
    events = some_events(spark, 10).limit(0)
    lake = new_lake(spark, scratch, events)
    assert lake.events(spark).count() == 0 and PG.top_pages(spark, lake).count() == 0
    assert lake.append(events, 0)
    assert lake.events(spark).count() == 0 and PG.page_rules(spark, lake, as_of(), BY_ID).count() == 0
