"""forward_window_stats (sliced, skew-safe) against brute force."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from recentlake.operators.windows import forward_window_stats


def direct(df, width):
    """One range-frame window per key: simple, quadratic and not skew-safe."""
    w = Window.partitionBy("k")
    frame = w.orderBy("t").rangeBetween(0, width)
    return df.select("k", "t", F.count("*").over(w.partitionBy("k", "t")).alias("rows"), F.count("*").over(frame), F.max("t").over(frame),
                     F.count("*").over(w), F.min("t").over(w), F.max("t").over(w)).distinct()


def brute(rows, width):
    out = {}
    by_key = {}
    for k, t in rows:
        by_key.setdefault(k, []).append(t)
    for k, ts in by_key.items():
        for t in ts:
            inside = [u for u in ts if t <= u <= t + width]
            out.setdefault((k, t), (len(inside), max(inside), len(ts), min(ts), max(ts)))
    return out


@pytest.mark.parametrize("seed,slice_us", [(1, 10), (2, 30), (3, 60), (4, 7)])
def test_sliced_matches_brute_force(spark, seed, slice_us):
    rnd = random.Random(seed)
    rows = []
    for k in ("a", "b", "hot"):
        n = 400 if k == "hot" else rnd.randint(1, 40)
        for _ in range(n):
            t = rnd.choice([rnd.randint(0, 2000), rnd.randint(0, 50) * 30])  # ties and exact boundaries
            rows.append((k, t))
    df = spark.createDataFrame(rows, "k string, t long")
    widths = {"one": slice_us, "six": 6 * slice_us, "ten": 10 * slice_us}
    got = forward_window_stats(df, ["k"], "t", widths, slice_us=slice_us).collect()
    assert len(got) == len(set(rows)) and sum(r["rows"] for r in got) == len(rows)
    for name, width in widths.items():
        want = brute(rows, width)
        for r in got:
            c, last, n, first, lastk = want[(r["k"], r["t"])]
            assert (r[f"{name}_count"], r[f"{name}_last"]) == (c, last), (name, r)
            assert (r["key_count"], r["key_first"], r["key_last"]) == (n, first, lastk)


def test_direct_form_agrees(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("xyz"), rnd.randint(0, 500)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t long")
    a = sorted(tuple(r) for r in forward_window_stats(df, ["k"], "t", {"w": 50}, slice_us=10).collect())
    assert a == sorted(tuple(r) for r in direct(df, 50).collect())


def test_carry_min_is_key_minimum(spark):
    df = spark.createDataFrame([("a", 5, 9), ("a", 100, 3), ("b", 1, 7)], "k string, t long, s long")
    got = {(r["k"], r["t"]): r["key_min_s"]
           for r in forward_window_stats(df, ["k"], "t", {"w": 20}, slice_us=10, carry_min="s").collect()}
    assert got == {("a", 5): 3, ("a", 100): 3, ("b", 1): 7}


def test_one_exchange_of_grouped_times(spark):
    """Frames only grow, groups are (key, slice), and the join adds no further
    exchange to the event side."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", t) for t in range(100)], "k string, t long").select(
            F.coalesce("k", F.lit("")).alias("k"), F.coalesce("t", F.lit(0).cast("long")).alias("t"))
        out = forward_window_stats(df, ["k"], "t", {"w": 30}, slice_us=10)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(k#" in plan and "_f#" in plan and "SortMergeJoin" in plan
    # (k, t) partial sums, their copies by (k, slice), slice totals by (k, slice) and by k, and by (k, slice) for the join
    assert plan.count("Exchange hashpartitioning") <= 6
    assert plan.count("_at#") and "specifiedwindowframe(RangeFrame, 0" not in plan


def test_a_hot_minute_and_a_pile_of_equal_times_are_linear(spark):
    import time

    burst = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 290 + 60_000_000).alias("t"))
    pile = spark.range(200_000).select(F.lit("pile").alias("k"), F.lit(7).cast("long").alias("t"))
    start = time.time()
    got = forward_window_stats(burst.unionByName(pile), ["k"], "t", {"w5": 300_000_000, "w2": 120_000_000}) \
        .groupBy("k").agg(F.count("*"), F.max("w5_count"), F.min("w2_count"), F.max("key_count")).collect()
    assert {tuple(r) for r in got} == {("hot", 200_000, 200_000, 1, 200_000), ("pile", 1, 200_000, 200_000, 200_000)}
    assert time.time() - start < 60
