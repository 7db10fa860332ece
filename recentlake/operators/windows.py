"""Forward time-window counts per key: exact, linear and skew-safe.

For every distinct time t (µs) of a key k, and for each requested width w,
``forward_window_stats`` gives

    <name>_count = #rows of k with t <= t' <= t + w     (closed interval)
    <name>_last  = max t' over those rows

plus per-key totals (count, first, last time, smallest ``carry_min``).

Rows of one key and time are first summed map-side, so any number of them is
one row afterwards.  Time is cut into slices of ``slice_us`` (w = m * slice).
A time in slice f sees

    own slice f           rows with t' >= t          total minus running count
    slices f+1 .. f+m-1   all rows                   per-slice totals
    slice f+m             rows with t' - w <= t      running count of marks

Each time is copied once per distinct m as a mark at t' - w into the group of
slice f-m.  A group (k, f) is read once in the order of its marks and times
with frames that only grow (UNBOUNDED PRECEDING .. CURRENT ROW): constant
work for each row, however many rows a page has in a minute.  The middle
slices come from a table with one row per occupied slice of a key, bounded
by time span / slice and joined on the columns that the groups are already
clustered by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SLICE_US = 60_000_000  # 60 s: groups of (key, minute); a key's share of one task stays bounded by time


def _slice_of(t_col: str, slice_us: int) -> Column:
    """floor(t / slice) in exact long arithmetic (SQL ``div`` truncates; the
    numerator is a multiple of the slice, so truncation is the floor)."""
    return F.expr(f"(`{t_col}` - pmod(`{t_col}`, {int(slice_us)})) div {int(slice_us)}")


def _pick_slice(widths: Mapping[str, int]) -> int:
    if all(w % DEFAULT_SLICE_US == 0 for w in widths.values()):
        return DEFAULT_SLICE_US
    g = 0
    for w in widths.values():
        a, b = g, w
        while b:
            a, b = b, a % b
        g = a
    return g


def forward_window_stats(
    df: DataFrame,
    keys: Sequence[str],
    t_col: str,
    widths: Mapping[str, int],
    slice_us: int | None = None,
    carry_min: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Forward window counts / lasts for several widths + key totals.

    ``widths`` maps an output prefix to a width in the units of ``t_col``.
    One output row per distinct (keys, ``t_col``): ``*keys, t_col, rows``
    (rows at that time), ``<p>_count, <p>_last`` for each prefix,
    ``key_count, key_first, key_last`` and ``key_min_<carry_min>``.  Keys,
    times and ``carry_min`` (a long) must be non-null (callers default them).
    ``weight`` is a column with the number of rows that a row stands for.
    """
    keys = list(keys)
    slice_us = slice_us or _pick_slice(widths)
    for w in widths.values():
        if w % slice_us:
            raise ValueError("every width must be a multiple of slice_us")
    steps = {name: w // slice_us for name, w in widths.items()}

    aggs = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")]
    if carry_min:
        aggs.append(F.min(carry_min).alias("_carry"))
    times = df.groupBy(*keys, F.col(t_col).alias("_t")).agg(*aggs).withColumn("_slice", _slice_of("_t", slice_us))

    # (a) own times, and marks of the slice m further on, in groups (key, slice)
    copies = F.array(
        F.struct(F.col("_slice").alias("f"), F.col("_t").alias("at"), F.lit(0).cast("long").alias("role")),
        *[F.struct((F.col("_slice") - F.lit(m)).alias("f"), (F.col("_t") - F.lit(m * slice_us)).alias("at"),
                   F.lit(m).cast("long").alias("role")) for m in sorted(set(steps.values()))],
    )
    rows = (
        times.select(*keys, "_t", "_n", F.explode(copies).alias("_c"))
        .select(*keys, "_t", "_n", F.col("_c.f").alias("_f"), F.col("_c.at").alias("_at"), F.col("_c.role").alias("_role"))
        .repartition(*keys, "_f")
    )
    own = F.col("_role") == 0
    group = Window.partitionBy(*keys, "_f")
    # marks before the times they equal: both ends of the interval are closed
    upto = group.orderBy("_at", own.cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_n = F.when(own, F.col("_n"))
    edges = [
        (F.sum(own_n).over(group) - F.sum(own_n).over(upto) + F.col("_n")).alias("_own_n"),
        F.max(F.when(own, F.col("_t"))).over(group).alias("_own_last"),
    ]
    for name, m in steps.items():
        mark = F.col("_role") == m
        edges += [F.coalesce(F.sum(F.when(mark, F.col("_n"))).over(upto), F.lit(0)).alias(f"_{name}_en"),
                  F.max(F.when(mark, F.col("_t"))).over(upto).alias(f"_{name}_em")]
    placed = rows.select(*keys, "_f", "_t", "_n", "_role", *edges).filter(own)

    # (b) totals per (key, slice) and their windows over the key's slices
    slice_aggs = [F.sum("_n").alias("_sn"), F.min("_t").alias("_mn"), F.max("_t").alias("_mx")]
    if carry_min:
        slice_aggs.append(F.min("_carry").alias("_cm"))
    slices = times.groupBy(*keys, F.col("_slice").alias("_f")).agg(*slice_aggs)
    by_key = Window.partitionBy(*keys)
    stat_cols = [
        F.sum("_sn").over(by_key).alias("key_count"),
        F.min("_mn").over(by_key).alias("key_first"),
        F.max("_mx").over(by_key).alias("key_last"),
    ]
    if carry_min:
        stat_cols.append(F.min("_cm").over(by_key).alias(f"key_min_{carry_min}"))
    in_order = by_key.orderBy("_f")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slice_stats = slices.select(*keys, "_f", "_sn", "_mx", *stat_cols, F.sum("_sn").over(running).alias("_run"))
    # Rows of the slices after this one and before f + m: the running total at
    # the last of them minus that of this slice.  A key has at most one row per
    # occupied slice here, and the frame at most m - 1 rows.
    middle_cols = []
    for name, m in steps.items():
        if m > 1:
            middle = in_order.rangeBetween(1, m - 1)
            middle_cols += [F.coalesce(F.max("_run").over(middle) - F.col("_run"), F.lit(0)).alias(f"_{name}_mn"),
                            F.max("_mx").over(middle).alias(f"_{name}_mm")]
        else:
            middle_cols += [F.lit(0).cast("long").alias(f"_{name}_mn"), F.lit(None).cast("long").alias(f"_{name}_mm")]
    totals = ["key_count", "key_first", "key_last"] + ([f"key_min_{carry_min}"] if carry_min else [])
    slice_stats = slice_stats.select(*keys, "_f", *totals, *middle_cols)

    out_cols = [*[F.col(k) for k in keys], F.col("_t").alias(t_col), F.col("_n").alias("rows")]
    for name in widths:
        out_cols += [
            (F.col("_own_n") + F.col(f"_{name}_en") + F.col(f"_{name}_mn")).alias(f"{name}_count"),
            F.greatest("_own_last", f"_{name}_em", f"_{name}_mm").alias(f"{name}_last"),
        ]
    return placed.join(slice_stats, [*keys, "_f"]).select(*out_cols, *totals)


def key_window_stats(
    df: DataFrame,
    keys: Sequence[str],
    t_col: str,
    widths: Mapping[str, int],
    carry_min: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The rows of ``forward_window_stats`` from groups of whole keys.

    Every step asks for rows that are clustered by ``keys`` and nothing finer:
    an input that is stored in buckets of its keys is not shuffled at all.  In
    return one task reads all times of a key, so this is for keys of bounded
    size (``sinks.page_lake`` keeps the larger ones apart).

    Each time t is copied once per width as a mark at t - w.  In the order of
    marks and times, the marks up to t are the rows with t' <= t + w and the
    times before t are those to take off: frames that only grow.
    """
    keys = list(keys)
    aggs = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("_n")]
    if carry_min:
        aggs.append(F.min(carry_min).alias("_carry"))
    times = df.groupBy(*keys, F.col(t_col).alias("_t")).agg(*aggs)
    copies = F.array(
        F.struct(F.col("_t").alias("at"), F.lit("").alias("role")),
        *[F.struct((F.col("_t") - F.lit(w)).alias("at"), F.lit(name).alias("role")) for name, w in widths.items()],
    )
    kept = [*keys, *times.columns[len(keys):]]
    rows = times.select(*kept, F.explode(copies).alias("_c")).select(*kept, F.col("_c.at").alias("_at"), F.col("_c.role").alias("_role"))
    own = F.col("_role") == ""
    group = Window.partitionBy(*keys)
    # marks before the times they equal: both ends of the interval are closed
    upto = group.orderBy("_at", own.cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_n, own_t = F.when(own, F.col("_n")), F.when(own, F.col("_t"))
    before = F.sum(own_n).over(upto) - F.col("_n")
    stats = [F.sum(own_n).over(group).alias("key_count"), F.min(own_t).over(group).alias("key_first"),
             F.max(own_t).over(group).alias("key_last")]
    if carry_min:
        stats.append(F.min("_carry").over(group).alias(f"key_min_{carry_min}"))
    found = []
    for name in widths:
        mark = F.col("_role") == name
        found += [(F.sum(F.when(mark, F.col("_n"))).over(upto) - before).alias(f"{name}_count"),
                  F.max(F.when(mark, F.col("_t"))).over(upto).alias(f"{name}_last")]
    return rows.select(*keys, F.col("_t").alias(t_col), F.col("_n").alias("rows"), *found, *stats, own.alias("_own")) \
        .where("_own").drop("_own")
