"""Offsets seen so far as bitmaps (L2, S15, A22 against history).

One bitmap of 32,768 offsets a row, by topic partition and bucket: 4 KB stand
for what would be 32,768 rows.  A new file is deduplicated against the whole
lake by a join with the bitmaps of the buckets that it touches; old messages
are not read again and not shuffled.  Bitmaps merge by OR, so each batch adds
its own and readers merge.

Offsets that are missing between the first and the last one of a partition
(gaps) come from the bitmaps alone, as ranges: bits missing inside a bitmap
are ranges of their bucket, ranges that reach the edges of neighbouring
buckets are joined, and buckets without a row are ranges between rows.

Messages without a partition or an offset are never duplicates and have no
bit.  Negative offsets do not occur in a log and are treated like none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recentlake.operators.live import dedupe_offsets
from recentlake.sinks.published import Published

#: Offsets of one bitmap, as ``bitmap_construct_agg`` has them.
BITS = 32_768
BITMAPS = "kafka_partition int, bucket bigint, bits binary"

_PARTITION, _OFFSET = "kafka_partition", "kafka_offset"


def _has_place(partition: str = _PARTITION, offset: str = _OFFSET) -> Column:
    return F.col(partition).isNotNull() & F.coalesce(F.col(offset) >= 0, F.lit(False))


def _bucket(offset: str = _OFFSET) -> Column:
    return F.expr(f"cast(`{offset}` div {BITS} as bigint)")


def offset_bitmaps(events: DataFrame) -> DataFrame:
    """``kafka_partition, bucket, bits`` of the messages' offsets; combined
    map-side, so a task sends one bitmap for a bucket."""
    return events.where(_has_place()).select(
        F.col(_PARTITION).cast("int").alias(_PARTITION), _bucket().alias("bucket"),
        F.expr(f"cast(`{_OFFSET}` % {BITS} as bigint)").alias("_bit"),
    ).groupBy(_PARTITION, "bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("bits"))


def merged(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.groupBy(_PARTITION, "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def _bit_is_set(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` (0..32767) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def flag_known(events: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``events`` with ``known``: whether the message's offset is in ``bitmaps``."""
    held = bitmaps.select(F.col(_PARTITION).alias("_p"), F.col("bucket").alias("_b"), F.col("bits").alias("_bits"))
    at = F.expr(f"`{_OFFSET}` % {BITS}")
    place = F.when(_has_place(), _bucket())
    joined = events.withColumn("_bucket", place).join(
        held, (F.col(_PARTITION) == F.col("_p")) & (F.col("_bucket") == F.col("_b")), "left")
    known = F.col("_bits").isNotNull() & _bit_is_set(F.col("_bits"), at)
    return joined.select(*[F.col(f"`{c}`") for c in events.columns], known.alias("known"))


def offset_gaps(bitmaps: DataFrame) -> DataFrame:
    """``kafka_partition, first_missing, last_missing, missing``: ranges of
    offsets between a partition's first and last one that no bitmap has."""
    p = _PARTITION
    rows = merged(bitmaps)
    # bytes of a bitmap that are not full, then their bits
    byte = F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda i: F.struct(
            i.alias("i"), F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int").alias("v"))),
        lambda b: b["v"] != 255))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.call_function("shiftright", F.col("_byte.v"), j).bitwiseAND(F.lit(1)) == 0))
    zeros = rows.select(p, "bucket", byte.alias("_byte")).select(p, "bucket", "_byte", bit.alias("_j")).select(
        p, "bucket", (F.col("_byte.i") * 8 + F.col("_j")).cast("bigint").alias("_at"))
    in_bucket = Window.partitionBy(p, "bucket").orderBy("_at")  # at most 32,768 rows
    inside = zeros.withColumn("_run", F.col("_at") - F.row_number().over(in_bucket)).groupBy(p, "bucket", "_run").agg(
        F.min("_at").alias("a"), F.max("_at").alias("b"))
    base = F.col("bucket") * BITS
    inside = inside.select(p, (base + F.col("a")).alias("a"), (base + F.col("b")).alias("b"),
                           (F.col("a") == 0).alias("_open"), (F.col("b") == BITS - 1).alias("_open_end"))
    # whole buckets that are missing: between one row of a partition and the next
    by_bucket = Window.partitionBy(p).orderBy("bucket")
    following = F.lead("bucket").over(by_bucket)
    between = rows.select(p, ((F.col("bucket") + 1) * BITS).alias("a"), (following * BITS - 1).alias("b")).where("a <= b").select(
        p, "a", "b", F.lit(True).alias("_open"), F.lit(True).alias("_open_end"))
    ranges = inside.unionByName(between)
    # only ranges that reach a bucket's edge can go on in the next bucket: two a bucket at most
    edge = ranges.where(F.col("_open") | F.col("_open_end"))
    by_start = Window.partitionBy(p).orderBy("a")
    starts = (F.col("a") != F.coalesce(F.lag("b").over(by_start), F.lit(-2)) + 1).cast("int")
    island = edge.withColumn("_new", starts).withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy(p, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(p, "a", "b")
    whole = ranges.where(~F.col("_open") & ~F.col("_open_end")).select(p, "a", "b").unionByName(joined)
    # what lies before the first and after the last offset is no gap
    reach = rows.groupBy(p).agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last"))
    inner = whole.join(reach, p)
    before = (F.col("a") == F.col("_first") * BITS)
    after = F.col("b") == (F.col("_last") + 1) * BITS - 1
    return inner.where(~before & ~after).select(
        p, F.col("a").alias("first_missing"), F.col("b").alias("last_missing"), (F.col("b") - F.col("a") + 1).alias("missing"))


class SeenOffsets:
    """Offsets of all batches so far, under ``root``."""

    def __init__(self, root: str):
        self.store = Published(root)

    def bitmaps(self, spark: SparkSession) -> DataFrame:
        return merged(self.store.read(spark, "bitmaps", BITMAPS))

    def fresh(self, events: DataFrame) -> DataFrame:
        """``events`` that no earlier batch had, one of each (partition, offset)."""
        unseen = flag_known(events, self.bitmaps(events.sparkSession)).where(~F.col("known")).drop("known")
        return dedupe_offsets(unseen)

    def add(self, events: DataFrame, batch_id: str | int) -> bool:
        """Note the offsets of ``events``; False for a committed batch."""
        return self.store.publish({"bitmaps": offset_bitmaps(events)}, batch_id)

    def volume(self, spark: SparkSession) -> DataFrame:
        """``kafka_partition, messages, end_offset, missing`` from bitmaps alone
        (A22: the end is one past the last offset)."""
        bitmaps = self.bitmaps(spark)
        gaps = offset_gaps(bitmaps).groupBy(_PARTITION).agg(F.sum("missing").alias("missing"))
        return volumes(bitmaps).join(gaps, _PARTITION, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))

    def compact(self, spark: SparkSession) -> bool:
        """One row a partition and bucket instead of one a batch."""
        return bool(self.store.batches(spark)) and self.store.rewrite({"bitmaps": self.bitmaps(spark)})


def volumes(bitmaps: DataFrame) -> DataFrame:
    """Messages and end offset of each partition."""
    # the last set bit: the last byte that is not zero, in the hex of the bitmap
    digits = F.regexp_replace(F.hex("bits"), "(00)+$", "")
    last_byte = F.floor(F.length(digits) / 2) - 1
    value = F.conv(F.substring(digits, F.length(digits) - 1, F.lit(2)), 16, 10).cast("int")
    top = F.floor(F.log2(value.cast("double")))
    end = F.col("bucket") * BITS + last_byte * 8 + top + 1
    return bitmaps.groupBy(_PARTITION).agg(
        F.sum(F.expr("bitmap_count(bits)")).alias("messages"), F.max(end).cast("bigint").alias("end_offset"))
