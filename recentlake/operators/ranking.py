"""Top-N with sequential rank (T1) and full count-desc ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_order(count_col: str, key_cols: Sequence[str]) -> list[Column]:
    """Count descending, then keys ascending (deterministic tie order)."""
    return [F.col(count_col).desc()] + [F.col(k).asc_nulls_first() for k in key_cols]


def top_n(counts: DataFrame, n: int, count_col: str, key_cols: Sequence[str],
          rank_col: str = "rank") -> DataFrame:
    """Keep the ``n`` largest counts and number them 1..n.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each partition keeps
    its own top ``n`` and only those rows reach the final merge, so the full
    aggregate is never sorted.  The rank window then runs over at most ``n``
    rows; for a whole aggregate use ``sorted_counts``, which numbers nothing.
    """
    order = count_order(count_col, key_cols)
    w = Window.orderBy(*order)
    return counts.orderBy(*order).limit(n).withColumn(rank_col, F.row_number().over(w).cast("long"))


def sorted_counts(counts: DataFrame, count_col: str, key_cols: Sequence[str]) -> DataFrame:
    """``most_common()`` without a limit: the whole aggregate, count-desc."""
    return counts.orderBy(*count_order(count_col, key_cols))


#: Groups of keys whose sums bound the counts of their keys.
BOUND_GROUPS = 1 << 20


def top_counts(rows: DataFrame, n: int, keys: Sequence[str], count_col: str = "edit_count", groups: int = BOUND_GROUPS) -> DataFrame:
    """The ``n`` most frequent ``keys`` of ``rows`` with rank, exact, without
    shuffling the tail of the keys.

    Keys fall into ``groups`` by hash.  A group's number of rows bounds the
    count of each of its keys from above, and costs one small row a group.
    The keys of the largest groups are counted first; the n-th count among
    them bounds the answer from below.  Only keys of groups that reach that
    bound can be among the top n, and only they are shuffled.  The driver
    holds the numbers of those groups, ``groups`` at most.

    A key set without frequent keys (all counts alike) leaves most groups over
    the bound; then this is the plain count, at the price of two more scans of
    the key columns.  Ties are ordered by key, so groups that just reach the
    bound stay in.
    """
    grouped = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"))
    sums = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    head = [r["_group"] for r in sums.orderBy(F.desc("_rows"), "_group").limit(2 * n).collect()]

    def counts(where: Column) -> DataFrame:
        return grouped.where(where).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))

    best = counts(F.col("_group").isin(head)).orderBy(F.col(count_col).desc()).limit(n).agg(
        F.count(F.lit(1)).alias("n"), F.min(count_col).alias("least")).first()
    if best["n"] < n:  # fewer keys than asked for in the largest groups: no bound
        return top_n(counts(F.lit(True)), n, count_col, keys)
    reach = [r["_group"] for r in sums.where(F.col("_rows") >= best["least"]).select("_group").collect()]
    kept = rows.sparkSession.createDataFrame([(g,) for g in reach], "_group bigint")
    # at most ``groups`` longs by construction
    near = grouped.join(F.broadcast(kept), "_group", "left_semi")
    return top_n(near.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col)), n, count_col, keys)
