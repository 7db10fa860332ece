"""Mixing sources to target weights (operator 10): a time-varying curriculum.

Every source has a share of the mix and a weight schedule over training time
``t`` in [0, 1]: ``weight(t) = share * (1 + slope * (2 t - 1))``.  Its integral
gives the cumulative token demand ``target * ((1 - slope) t + slope t^2)``.
The documents of a source, in a fixed pseudo-random order and at most
``MAX_REPEATS`` times over, supply that demand; the training position of a
copy is the inverse of the demand at the copy's middle token.  Rows are then
range-sorted by position.

Targets: the shares are proportional to the weights, and no target exceeds
``MAX_REPEATS`` times its source's size; the excess is shared again by weight.
This is the largest common level ``L`` with ``sum(min(cap, weight * L))`` equal
to all sizes, found in closed form on the table of sources.

A source is taken in whole documents: a copy is in the mix when its middle
token lies below the target, so that a source's words differ from its target
by at most half a document.

The cumulative sizes come from two levels: sums per (source, order bucket),
their running total over at most ``16 ** BUCKET_DIGITS`` rows a source, and a
running total inside each bucket.  No window holds a whole source, nor the rows
of one id.  The tables of sources are ordered in one task: a row a source, which
is some 100 MB for a million sources.

Special cases: null source is a source of its own, last in order; null text
has size 0; documents of size 0 are never taken and have no position; equal
rows are taken one after the other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recentlake.llm.common import n_words_column, saved

WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
BUCKET_DIGITS = 3


def row_key():
    """Tells rows of one ``doc_id`` apart by their text."""
    return F.xxhash64("source", "text")


def document_sizes(docs: DataFrame) -> DataFrame:
    # Of the id and the text: rows of one id, or of none, spread over the buckets.
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return docs.select("doc_id", "source", row_key().alias("row_key"), n_words_column().alias("size"),
                       order.alias("order_key"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, weight, slope, target``: one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(by_name) - 1
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long").alias("weight"),
        F.element_at(F.array(*map(F.lit, SLOPES)), (rank % len(SLOPES) + 1).cast("int")).alias("slope"),
        rank.alias("rank"))
    # In the order of cap / weight, the sources before a level's first uncapped one are capped.
    cap = F.lit(MAX_REPEATS) * F.col("source_size")
    by_level = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = table.withColumn("cap", cap).select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"))
    levels = levels.withColumn("capped", F.col("cap") * F.col("weights") < F.col("left") * F.col("weight"))
    # Weights only fall along the order: the first uncapped row has the most left.
    free = F.max(F.when(~F.col("capped"), F.struct("weights", "left"))).over(every)
    return levels.select(
        "source", "source_size", "weight", "slope",
        F.when(F.col("capped"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * free["left"]).cast("double") / free["weights"].cast("double")).alias("target"))


def mix_plan(docs: DataFrame) -> DataFrame:
    """One row per document: its source's size and target, ``copies``,
    ``taken`` words and the training ``positions`` of its copies."""
    sizes = saved(document_sizes(docs), "sizes")
    targets = source_targets(sizes)
    bucket = F.substring("order_key", 1, BUCKET_DIGITS)
    placed = sizes.withColumn("bucket", bucket)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("__s"), F.col("bucket").alias("__b"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc_id", "row_key", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    placed = placed.drop("__s", "__b").join(
        targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    start = F.col("bucket_start") + F.col("within")
    middles = F.array(*((F.lit(2 * e) * F.col("source_size") + 2 * start + F.col("size")) / F.lit(2.0)
                        for e in range(MAX_REPEATS)))
    used = F.when(F.col("size") > 0, F.filter(middles, lambda m: m < F.col("target"))).otherwise(F.array().cast("array<double>"))
    slope = F.col("slope")

    def when(m):
        u = m / F.col("target")
        root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
        return F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope))

    return placed.withColumn("__used", used).select(
        "doc_id", "row_key", "source", "size", "source_size", "target",
        F.size("__used").alias("copies"), (F.size("__used") * F.col("size")).cast("long").alias("taken"),
        F.transform("__used", when).alias("positions"))


def mixed(docs: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the order of
    their training ``position``, which is added (or replaces such a column)."""
    plan = mix_plan(docs) if plan is None else plan
    copies = plan.where("copies > 0").select(
        F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"),
        F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy(F.element_at("positions", 1))).alias("__i"),
        "positions")
    numbered = docs.withColumn("__key", row_key()).withColumn(
        "__turn", F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(F.lit(0))))
    joined = numbered.join(
        copies, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")) & (F.col("__turn") == F.col("__i")))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c != "position"), F.explode("positions").alias("position")) \
        .orderBy("position", "doc_id")
