"""Reports from carried partial counts (A1-A15, A19): new files only.

``update`` counts the files of the lake that are new, by file and day, in one
scan with GROUPING SETS, and publishes the counts; every report then merges
the counts instead of reading the lake.  All carried figures are sums, so
merging is one aggregate over them.

A file is known by a number of its path, time of change and length, which the
listing has: files that were counted before are not opened.  A late file is
just a new one, whatever days its events have.  The counts of a file that was
rewritten or removed stay in the table, but its number is noted as gone and
they are no longer merged.  A file that changes while it is read is counted
under a number that no listing had, so it is left out and read next time.

Rows ``version, batch, day, dim, k1, k2`` with the sums ``event_count, bots,
not_bots, anonymous, created, deleted``:

  dim     k1            k2     figures
  total   -             -      one row a file and day
  minute  minute (µs)   -      hours are sums of minutes
  wiki    raw wiki      -      languages and page wikis are made of it
  page    title         wiki   also created and deleted pages
  user    raw user      -      also bots
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import reports as R
from recentlake.operators.ranking import sorted_counts, top_n
from recentlake.sinks.published import Published
from recentlake.sources.files import list_files, open_files

SUMS = ("event_count", "bots", "not_bots", "anonymous", "created", "deleted")
FILE_KEY = ("version", "batch")
COUNTS = "version bigint, batch string, day date, dim string, k1 string, k2 string, " + ", ".join(f"{c} bigint" for c in SUMS)
FILES = "version bigint, batch string, path string"
GONE = "version bigint, batch string"


def partial_counts(events: DataFrame, batch_id: str) -> DataFrame:
    """``events`` as partial counts by ``version`` (the number of their file)
    and day: each row is expanded inside the map-side aggregate and only
    distinct keys are shuffled."""
    ts = R._ts(events)
    rows = events.select(
        "version", F.to_date(ts).alias("day"),
        C.bucket_us(F.unix_micros(ts), R.MINUTE_US).cast("string").alias("minute"), F.col("wiki").alias("raw_wiki"),
        C.page_title("title").alias("title"), C.page_wiki("wiki").alias("page_wiki"), F.col("user").alias("raw_user"),
        F.col("is_bot"), C.is_true("is_anonymous").alias("anon"),
        C.is_create("event_type").alias("new"), C.is_delete("event_type").alias("gone"))
    both = ["version", "day"]
    sets = {"minute": ["minute"], "wiki": ["raw_wiki"], "page": ["title", "page_wiki"], "user": ["raw_user"], "total": []}
    keys = ["minute", "raw_wiki", "title", "page_wiki", "raw_user"]
    counts = rows.groupingSets([both + s for s in sets.values()], *both, *keys).agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if(C.is_true("is_bot")).alias("bots"),
        F.count_if(F.col("is_bot") == F.lit(False)).alias("not_bots"), F.count_if("anon").alias("anonymous"),
        F.count_if("new").alias("created"), F.count_if("gone").alias("deleted"), F.grouping_id().alias("gid"))
    # grouping_id bits of keys, minute the highest; 0 where a key is grouped by
    dim = F.lit("total")
    for name, own in sets.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        dim = F.when(F.col("gid") == bits, F.lit(name)).otherwise(dim)
    return counts.select("version", F.lit(batch_id).alias("batch"), "day", dim.alias("dim"), F.coalesce("minute", "raw_wiki", "title", "raw_user").alias("k1"),
                         F.col("page_wiki").alias("k2"), *SUMS)


class ReportTable:
    """The carried counts of one lake, under ``root``."""

    def __init__(self, root: str):
        self.store = Published(root)

    def files(self, spark: SparkSession) -> DataFrame:
        """Files whose counts are merged: ``version, batch, path``."""
        gone = self.store.read(spark, "gone", GONE)
        return self.store.read(spark, "files", FILES).join(gone, list(FILE_KEY), "left_anti")

    def update(self, spark: SparkSession, roots: Sequence[str], batch_id: str, fmt: str = "json",
               glob: str = "*.json") -> list[str]:
        """Count the files under ``roots`` that are new; their paths are returned.

        The paths of one batch are held by the driver, as Spark's file index
        holds them to open the files.  A batch id that was committed before
        changes nothing.
        """
        if batch_id in self.store.batches(spark):
            return []
        listed, known = list_files(spark, roots, glob), self.files(spark)
        fresh = {r["path"]: r["version"] for r in listed.join(known, "version", "left_anti").collect()}
        gone = known.join(listed, "version", "left_anti").select(*FILE_KEY)
        tables = {"gone": gone}
        if fresh:
            tables["counts"] = partial_counts(open_files(spark, sorted(fresh), fmt), batch_id)
            tables["files"] = spark.createDataFrame([(v, batch_id, p) for p, v in sorted(fresh.items())], FILES)
        self.store.publish(tables, batch_id)
        return sorted(fresh)

    def _alive(self, spark: SparkSession) -> DataFrame:
        return self.store.read(spark, "counts", COUNTS).join(self.files(spark), list(FILE_KEY), "left_semi")

    def counts(self, spark: SparkSession, since: str | None = None, until: str | None = None) -> DataFrame:
        """Merged counts ``dim, k1, k2`` and sums; ``since`` / ``until`` (days,
        inclusive) leave out other days and events without a time."""
        rows = self._alive(spark)
        if since:
            rows = rows.where(F.col("day") >= F.to_date(F.lit(since)))
        if until:
            rows = rows.where(F.col("day") <= F.to_date(F.lit(until)))
        return rows.groupBy("dim", "k1", "k2").agg(*(F.sum(c).alias(c) for c in SUMS))

    def merge(self, spark: SparkSession) -> bool:
        """One folder instead of one a batch, without the counts of gone files."""
        return bool(self.store.batches(spark)) and self.store.rewrite({"files": self.files(spark), "counts": self._alive(spark)})


# -- reports ---------------------------------------------------------------------


def _dim(counts: DataFrame, dim: str) -> DataFrame:
    return counts.where(F.col("dim") == dim)


def _total(counts: DataFrame) -> DataFrame:
    """One row, zeros when nothing was counted."""
    return _dim(counts, "total").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS))


def _summed(rows: DataFrame, key: Column, name: str, figure: str = "event_count", out: str = "event_count") -> DataFrame:
    return rows.where(F.col(figure) > 0).select(key.alias(name), figure).groupBy(name).agg(F.sum(figure).alias(out))


def _buckets(counts: DataFrame, key: Column, name: str, dim: str) -> DataFrame:
    return sorted_counts(_summed(_dim(counts, dim), key, name), "event_count", [name])


def _time_key(width_us: int, label) -> Column:
    start = F.timestamp_micros(C.bucket_us(F.col("k1").cast("bigint"), width_us))
    return F.coalesce(label(start), F.lit(S.UNKNOWN))


def _pages(counts: DataFrame, figure: str, n: int) -> DataFrame:
    pages = _dim(counts, "page").where(F.col(figure) > 0).select(F.col("k1").alias("title"), F.col("k2").alias("wiki"),
                                                                F.col(figure).alias("edit_count"))
    return top_n(pages, n, "edit_count", ["title", "wiki"]).select("rank", "title", "wiki", "edit_count")


def batch_summary(counts: DataFrame) -> DataFrame:
    return _total(counts).select(F.col("event_count").alias("total_events"), F.col("bots").alias("bot_events"),
                                 F.col("not_bots").alias("human_events"))


def batch_by_wiki(counts: DataFrame) -> DataFrame:
    return _buckets(counts, F.col("k1"), "wiki", "wiki")


def activity_by_minute(counts: DataFrame) -> DataFrame:
    return _buckets(counts, _time_key(R.MINUTE_US, C.minute_bucket), "minute", "minute")


def activity_by_hour(counts: DataFrame) -> DataFrame:
    return _buckets(counts, _time_key(R.HOUR_US, C.hour_bucket), "hour", "minute")


def language_distribution(counts: DataFrame) -> DataFrame:
    return _buckets(counts, C.wiki_to_language("k1"), "language", "wiki")


def activity_by_wiki(counts: DataFrame) -> DataFrame:
    return _buckets(counts, C.page_wiki("k1"), "wiki", "wiki")


def top_pages(counts: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    return _pages(counts, "event_count", n)


def most_created_pages(counts: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    return _pages(counts, "created", n)


def most_deleted_pages(counts: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    return _pages(counts, "deleted", n)


def top_contributors(counts: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    users = _dim(counts, "user").withColumn("by_humans", F.col("event_count") - F.col("bots"))
    return top_n(_summed(users, C.user_key("k1"), "user", "by_humans", "edit_count"), n, "edit_count", ["user"]).select(
        "rank", "user", "edit_count")


def active_bots(counts: DataFrame, n: int = S.TOP_LIMIT) -> DataFrame:
    bots = _summed(_dim(counts, "user"), C.user_key("k1", S.UNKNOWN_BOT), "bot_user", "bots", "edit_count")
    return top_n(bots, n, "edit_count", ["bot_user"]).select("rank", "bot_user", "edit_count")


def bots_vs_humans(counts: DataFrame) -> DataFrame:
    humans = F.col("event_count") - F.col("bots")
    return _total(counts).select("bots", humans.alias("humans"), C.pct("bots", "event_count").alias("bot_percentage"))


def bot_ratio(counts: DataFrame) -> DataFrame:
    return _total(counts).select(
        F.col("event_count").alias("total_events"), F.col("bots").alias("bot_volume"),
        (F.col("event_count") - F.col("bots")).alias("human_volume"), C.pct("bots", "event_count").alias("bot_percentage"))


def anonymous_vs_logged(counts: DataFrame) -> DataFrame:
    logged = F.col("event_count") - F.col("anonymous")
    return _total(counts).select("anonymous", logged.alias("logged_in"), C.pct("anonymous", "event_count").alias("anonymous_percentage"),
                                 C.pct(logged, "event_count").alias("logged_in_percentage"))


def daily_traffic(counts: DataFrame) -> DataFrame:
    hours = _dim(counts, "minute").where(F.col("k1").isNotNull())
    rows = _summed(hours, _time_key(R.HOUR_US, C.hour_bucket), "hour")
    # one row for each hour of the lake's time span
    rank = F.row_number().over(Window.orderBy(F.col("event_count").desc(), "hour")).cast("long").alias("rank")
    return rows.select(rank, "hour", "event_count")


#: Reports that the carried counts give, by the name of the full scan's report.
REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {f.__name__: f for f in (
    batch_summary, batch_by_wiki, activity_by_minute, activity_by_hour, language_distribution, activity_by_wiki, top_pages,
    most_created_pages, most_deleted_pages, top_contributors, active_bots, bots_vs_humans, bot_ratio, anonymous_vs_logged,
    daily_traffic)}
