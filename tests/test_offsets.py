"""Offset bitmaps against plain sets."""

import os
import random

from conftest import make_events
from pyspark.sql import functions as F

from recentlake.operators import offsets as O


def _gaps(offsets):
    have, out = sorted(offsets), []
    for a, b in zip(have, have[1:]):
        if b > a + 1:
            out.append((a + 1, b - 1, b - a - 1))
    return out


def _events(spark, pairs):
    return make_events(spark, [{"kafka_partition": p, "kafka_offset": o} for p, o in pairs])


CASES = {
    0: [0, 1, 2, 5, 6, 32767, 32768, 40000],
    1: [32766, 32769],                                   # a gap over a bucket's edge
    2: [5, 200_000],                                     # whole buckets missing
    3: [32767, 98304],                                   # whole buckets only
    4: [7],
    5: list(range(32768)) + [65536],
    6: [10**12, 10**12 + 3],
    7: [65535, 65536, 131071],
}


def test_gaps_and_volumes(spark, scratch):
    rng = random.Random(1)
    cases = CASES | {10 + k: rng.sample(range(200_000), rng.choice([50, 2000])) for k in range(3)}
    pairs = [(p, o) for p, offs in cases.items() for o in offs]
    rng.shuffle(pairs)
    odd = [(None, 5), (3, None), (None, None), (0, -1)]
    seen = O.SeenOffsets(os.path.join(scratch, "seen"))
    half = len(pairs) // 2
    seen.add(_events(spark, pairs[:half] + odd), 0)
    seen.add(_events(spark, pairs[half - 100:]), 1)
    assert not seen.add(_events(spark, [(0, 3)]), 1)  # a replayed batch adds nothing
    for _ in range(2):
        got = {}
        for r in O.offset_gaps(seen.bitmaps(spark)).collect():
            got.setdefault(r.kafka_partition, []).append(tuple(r)[1:])
        assert {p: sorted(g) for p, g in got.items()} == {p: _gaps(o) for p, o in cases.items() if _gaps(o)}
        assert {r.kafka_partition: tuple(r)[1:] for r in seen.volume(spark).collect()} == {
            p: (len(o), max(o) + 1, sum(g[2] for g in _gaps(o))) for p, o in cases.items()}
        assert seen.compact(spark)  # the same from merged bitmaps


def test_new_messages_against_history(spark, scratch):
    rng = random.Random(2)
    seen = O.SeenOffsets(os.path.join(scratch, "seen"))
    history = set()
    for batch in range(3):
        pairs = [(rng.randrange(3), rng.randrange(3000) * 31) for _ in range(1500)]
        pairs += rng.sample(pairs, 200) + [(None, None)] * 3 + [(1, None)] * 2
        ev = _events(spark, pairs)
        got = sorted(((r.kafka_partition, r.kafka_offset) for r in seen.fresh(ev).collect()), key=repr)
        keyed = {p for p in pairs if None not in p} - history
        # messages without both are all kept, those with one are told apart by it
        assert got == sorted([*keyed, *[(None, None)] * 3, (1, None)], key=repr)
        seen.add(ev, batch)
        history |= keyed


def test_history_is_not_shuffled_row_by_row(spark):
    """The join meets one row a bucket, not one a message."""
    old = spark.range(300_000).select(F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"))
    assert O.offset_bitmaps(old).count() == 300_000 // O.BITS + 1
    new = spark.range(299_990, 300_010).select(F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"))
    assert [r.kafka_offset for r in O.flag_known(new, O.offset_bitmaps(old)).where("not known").orderBy("kafka_offset").collect()] == \
        list(range(300_000, 300_010))


def test_nothing_seen(spark, scratch):
    seen = O.SeenOffsets(os.path.join(scratch, "seen"))
    assert O.offset_gaps(seen.bitmaps(spark)).count() == 0 and seen.volume(spark).count() == 0
    assert seen.fresh(_events(spark, [(0, 1), (0, 1), (0, 2)])).count() == 2
    assert seen.add(_events(spark, [(0, 1)]).limit(0), 0) and seen.volume(spark).count() == 0
