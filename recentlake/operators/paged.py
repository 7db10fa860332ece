"""Page reports (A8) and page windows (Q6, Q7) over a lake bucketed by page.

The bucketed rows are grouped and windowed where they lie, without an exchange;
the rows of hot pages go through the shuffled forms, which split a page.  A page
is in one of the two, so the results are those of the whole lake.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators import anomalies as A
from recentlake.operators.ranking import top_n
from recentlake.operators.windows import forward_window_stats, key_window_stats
from recentlake.sinks.page_lake import PAGE, PageLake


def page_counts(spark: SparkSession, lake: PageLake) -> DataFrame:
    """Events a page: title, wiki, edit_count."""
    counts = [rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("edit_count")) for rows in (lake.pages(spark), lake.hot(spark))]
    return counts[0].unionByName(counts[1]).select(F.col(PAGE[0]).alias("title"), F.col(PAGE[1]).alias("wiki"), "edit_count")


def top_pages(spark: SparkSession, lake: PageLake, n: int = S.TOP_LIMIT) -> DataFrame:
    """``reports.top_pages`` over the lake: no exchange of its bucketed rows."""
    return top_n(page_counts(spark, lake), n, "edit_count", ["title", "wiki"]).select("rank", "title", "wiki", "edit_count")


def page_windows(rows: DataFrame, as_of: Column, order_cols: Sequence[str], bucketed: bool) -> DataFrame:
    """Window counts of every page and time for the page rules."""
    placed = A.page_times(rows, *PAGE, as_of, order_cols)
    if bucketed:
        return key_window_stats(placed, ["_title", "_wiki"], "_us", A.WIDTHS, carry_min="_seq")
    return forward_window_stats(placed, ["_title", "_wiki"], "_us", A.WIDTHS, carry_min="_seq")


def page_rules(spark: SparkSession, lake: PageLake, as_of: Column, order_cols: Sequence[str] = A.ORDER_COLS,
               rules: Sequence[str] = A.PAGE_RULES) -> DataFrame:
    """Hits of the page window rules (no cross-rule dedup)."""
    hits = [A.page_hits(page_windows(rows, as_of, order_cols, bucketed), rules)
            for rows, bucketed in ((lake.pages(spark), True), (lake.hot(spark), False))]
    return hits[0].unionByName(hits[1]).select(*S.ANOMALY_COLUMNS)
