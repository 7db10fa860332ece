"""Anomaly detection over new events only (Q9, Q10, Q12 with carried state).

A run reads the events of new files and what earlier runs carried over; its
result equals ``detect_anomalies`` over all events so far.  State is tables of
a :class:`Published` folder, one batch a run, only appended to:

  pages    title, wiki, run and the run's sums: events, first, last, order
  tails    times of a page's last minutes: width of the widest window and
           ``lateness`` before its last event
  windows  counts of the windows that may hit (``w5``, ``w2``); ``final`` once
           no event in time can change them
  resets   pages that a run recomputed from the whole history
  hits     per-event rule hits, first of each key in the run
  minutes  bot events by minute

A page's new events meet its tail, so windows that cross the boundary are
counted whole; windows that were not final are counted again and replace
those of the run before.  Sums are merged on read, so baselines always are
those of all events.  Pages with an event more than ``lateness`` before their
last one are recomputed from ``history`` (all events so far, these included),
and only they: a semi-join with their keys.

All state rows are keyed by page and time, and candidates are thinned within
a (page, slice) group: no page gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import anomalies as A
from recentlake.operators.frames import combine_rows
from recentlake.operators.windows import forward_window_stats
from recentlake.session import reuse
from recentlake.sinks.published import Published

PAGE = ["_title", "_wiki"]
_KEYS = "_title string, _wiki string, "
PAGES = _KEYS + "key_count bigint, key_first bigint, key_last bigint, key_min__seq bigint, run bigint"
TAILS = _KEYS + "_us bigint, _n bigint, run bigint"
WINDOWS = _KEYS + "_us bigint, w5_count bigint, w5_last bigint, w2_count bigint, w2_last bigint, final boolean, run bigint"
RESETS = _KEYS + "run bigint"
HITS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.ANOMALY.fields) + ", _phase int, _seq bigint, _rule int"
MINUTES = "minute bigint, n bigint, _seq bigint"


class AnomalyState:
    """Carried state of anomaly runs under ``root``."""

    def __init__(self, root: str, lateness_min: int = S.EDIT_SPIKE_WINDOW_MIN):
        self.store = Published(root)
        self.lateness = lateness_min * A.MINUTE_US
        self.kept = self.lateness + max(A.WIDTHS.values())

    # -- what is carried -------------------------------------------------------

    def pages(self, spark: SparkSession) -> DataFrame:
        """Totals of every page and the last run that had events of it."""
        return self.store.read(spark, "pages", PAGES).groupBy(*PAGE).agg(
            F.sum("key_count").alias("key_count"), F.min("key_first").alias("key_first"), F.max("key_last").alias("key_last"),
            F.min("key_min__seq").alias("key_min__seq"), F.max("run").alias("run"))

    def _windows(self, spark: SparkSession, pages: DataFrame) -> DataFrame:
        """Valid windows with their page's totals."""
        rows = self.store.read(spark, "windows", WINDOWS).withColumnRenamed("run", "_run")
        resets = self.store.read(spark, "resets", RESETS).groupBy(*PAGE).agg(F.max("run").alias("_reset"))
        known = rows.join(pages, PAGE).join(resets, PAGE, "left")
        current = (F.col("final") | (F.col("_run") == F.col("run"))) & (F.col("_run") >= F.coalesce("_reset", F.lit(0)))
        return known.where(current)

    # -- a run -----------------------------------------------------------------

    def update(self, events: DataFrame, as_of: Column, batch_id: str, history: DataFrame | None = None,
               order_cols: Sequence[str] = A.ORDER_COLS) -> bool:
        """Take in the new ``events``; False when ``batch_id`` is committed
        already.  ``history`` is read only if a page has late events."""
        spark = events.sparkSession
        done = self.store.batches(spark)
        if str(batch_id) in done:
            return False
        run = F.lit(len(done) + 1).cast("bigint")
        keyed = reuse(A._keyed(events, as_of, order_cols))
        new = keyed.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("key_count"), F.min("_us").alias("key_first"),
                                       F.max("_us").alias("key_last"), F.min("_seq").alias("key_min__seq"))
        before = self.pages(spark).select(*PAGE, F.col("key_last").alias("_before"), F.col("run").alias("_last_run"))
        touched = reuse(new.join(before, PAGE, "left").withColumn(
            "_late", F.coalesce(F.col("key_first") < F.col("_before") - self.lateness, F.lit(False))))

        narrow = keyed.select(*PAGE, "_us", F.lit(1).cast("bigint").alias("_n"))
        tails = self.store.read(spark, "tails", TAILS).withColumnRenamed("run", "_last_run")
        carried = tails.join(touched.select(*PAGE, "_last_run"), [*PAGE, "_last_run"], "left_semi").select(*PAGE, "_us", "_n")
        rows = narrow.unionByName(carried)
        late = touched.where("_late").select(*PAGE)
        resets = late.withColumn("run", run)
        if not late.isEmpty():
            if history is None:
                raise ValueError("events are later than the allowed lateness: their pages need the history")
            whole = A._keyed(history, as_of, order_cols).select(*PAGE, "_us", F.lit(1).cast("bigint").alias("_n"))
            rows = rows.join(late, PAGE, "left_anti").unionByName(whole.join(late, PAGE, "left_semi"))
        stats = reuse(forward_window_stats(rows, PAGE, "_us", A.WIDTHS, weight="_n"))
        settled = F.col("_us") < F.col("key_last") - self.kept
        self.store.publish({
            "pages": new.withColumn("run", run),
            "tails": stats.where(~settled).select(*PAGE, "_us", F.col("rows").alias("_n"), run.alias("run")),
            "windows": _thinned(stats).select(*PAGE, "_us", *(f"{w}_{x}" for w in A.WIDTHS for x in ("count", "last")),
                                              settled.alias("final"), run.alias("run")),
            "resets": resets,
            "hits": A.first_hits(A.event_rules(keyed, as_of)),
            "minutes": A.bot_minutes(keyed),
        }, batch_id)
        return True

    # -- results ---------------------------------------------------------------

    def anomalies(self, spark: SparkSession) -> DataFrame:
        """All anomalies of the events so far, as ``detect_anomalies`` gives them."""
        minutes = self.store.read(spark, "minutes", MINUTES).groupBy("minute").agg(F.sum("n").alias("n"), F.min("_seq").alias("_seq"))
        hits = (self.store.read(spark, "hits", HITS)
                .unionByName(A.page_hits(self._windows(spark, self.pages(spark))))
                .unionByName(A.bot_hits(minutes)))
        return A.first_hits(hits).select(*S.ANOMALY_COLUMNS)

    def report(self, spark: SparkSession, as_of: Column) -> DataFrame:
        """Run envelope (Q12) without reading an event: one row."""
        events = self.store.read(spark, "pages", PAGES).agg(F.coalesce(F.sum("key_count"), F.lit(0)).alias("events_analyzed"))
        return combine_rows(events, self.anomalies(spark).agg(F.count(F.lit(1)).alias("anomaly_count"))).select(
            C.iso_utc(as_of).alias("generated_at"), "events_analyzed", "anomaly_count")


def _thinned(stats: DataFrame) -> DataFrame:
    """Windows that may be the first hit of their page: those that count more
    than every earlier one of their (page, slice), and the first rapid one.
    For any threshold the first window that reaches it is among them."""
    may = stats.where((F.col("w5_count") >= S.EDIT_SPIKE_MIN_IN_WINDOW) | (F.col("w2_count") >= S.SPAM_EDITS_IN_WINDOW))
    slice_ = C.bucket_us("_us", A.MINUTE_US)
    earlier = Window.partitionBy(*PAGE, slice_).orderBy("_us").rowsBetween(Window.unboundedPreceding, -1)
    rapid = F.col("w2_count") >= S.SPAM_EDITS_IN_WINDOW
    return may.select("*", F.max("w5_count").over(earlier).alias("_most"), F.max(F.when(rapid, 1)).over(earlier).alias("_rapid")).where(
        F.col("_most").isNull() | (F.col("w5_count") > F.col("_most")) | (rapid & F.col("_rapid").isNull())).drop("_most", "_rapid")
