"""Pipeline monitoring operators.

Inputs are small metadata tables: Kafka end / committed offsets, scheduler
run logs, lake file listings.  They are joined and aggregated with plain
DataFrame operations; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake import schema as S
from recentlake.operators.frames import combine_rows
from recentlake.sources.files import path_exists


def end_offsets_from(messages: DataFrame, topic: str = "kafka_topic", partition: str = "kafka_partition",
                     offset: str = "kafka_offset") -> DataFrame:
    """End offset (last offset + 1) per (topic, partition) of a message log."""
    return messages.groupBy(F.col(topic).alias("topic"), F.col(partition).alias("partition")).agg(
        (F.max(offset) + 1).alias("end_offset")
    )


def committed_offsets_from(messages: DataFrame, consumed: Column, topic: str = "kafka_topic",
                           partition: str = "kafka_partition", offset: str = "kafka_offset") -> DataFrame:
    """Committed offset (last consumed + 1) per partition for rows ``consumed``."""
    return messages.filter(consumed).groupBy(F.col(topic).alias("topic"), F.col(partition).alias("partition")).agg(
        (F.max(offset) + 1).alias("committed_offset")
    )


def offset_lag(end_offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition: end, committed (0 when none), lag = max(0, end - committed).

    Both inputs have one row per (topic, partition); a topic has a handful of
    partitions, so the join is small whatever the message volume.
    """
    j = end_offsets.join(committed, ["topic", "partition"], "left")
    done = F.coalesce(F.col("committed_offset"), F.lit(0).cast("long"))
    return j.select(
        "topic", "partition", "end_offset", done.alias("committed_offset"),
        F.greatest(F.lit(0).cast("long"), F.col("end_offset") - done).alias("lag"),
    )


def lag_by_topic(lag: DataFrame) -> DataFrame:
    return lag.groupBy("topic").agg(F.sum("lag").alias("total_lag"), F.sum("end_offset").alias("volume"))


def topic_end_volume(end_offsets: DataFrame) -> DataFrame:
    """Topic volume as the sum of end offsets of its partitions."""
    return end_offsets.groupBy("topic").agg(F.sum("end_offset").alias("volume"))


# ---------------------------------------------------------------------------
# Scheduler run logs
# ---------------------------------------------------------------------------

def last_runs(runs: DataFrame) -> DataFrame:
    """Latest run per DAG (by start date, then run id)."""
    return runs.groupBy("dag_id").agg(
        F.max_by(F.struct("run_id", "state", "start_date", "is_paused"), F.struct("start_date", "run_id")).alias("r")
    ).select("dag_id", "r.*")


def _known_dags(runs: DataFrame, dags: DataFrame | None) -> DataFrame:
    """``dag_id`` of every DAG: the given list, or those with runs."""
    return (runs if dags is None else dags).select("dag_id").distinct()


def run_monitoring(runs: DataFrame, task_runs: DataFrame, dags: DataFrame | None = None) -> DataFrame:
    """Per DAG: last run state and id, tasks, failures and failure % of that run.

    ``dags`` lists the known DAGs; one without runs has null state and run
    and 0 tasks.  Rows: dag_id, is_paused, last_run_state, last_run_id,
    task_count, failed_tasks, failure_rate_pct (a run without tasks is 0 %),
    avg_task_duration_sec.
    """
    last = _known_dags(runs, dags).join(last_runs(runs), "dag_id", "left")
    tasks = task_runs.groupBy("dag_id", "run_id").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(F.col("state") == "failed").alias("failed_tasks"),
        F.avg("duration_sec").alias("avg_duration"),
    )
    j = last.join(tasks, ["dag_id", "run_id"], "left")
    n = F.coalesce(F.col("task_count"), F.lit(0).cast("long"))
    failed = F.coalesce(F.col("failed_tasks"), F.lit(0).cast("long"))
    return j.select(
        "dag_id", "is_paused",
        F.col("state").alias("last_run_state"),
        F.col("run_id").alias("last_run_id"),
        n.alias("task_count"),
        failed.alias("failed_tasks"),
        F.round(failed.cast("double") / F.greatest(n, F.lit(1)).cast("double") * F.lit(100.0), 2).alias(
            "failure_rate_pct"),
        F.round("avg_duration", 2).alias("avg_task_duration_sec"),
    )


def run_summary(runs: DataFrame, task_runs: DataFrame, dags: DataFrame | None = None) -> DataFrame:
    """One row: DAGs (those without runs too), failed / successful last runs,
    task failures and mean task duration over the last runs."""
    last = last_runs(runs)
    t = task_runs.join(last.select("dag_id", "run_id"), ["dag_id", "run_id"], "left_semi")
    dag_part = _known_dags(runs, dags).join(last, "dag_id", "left").agg(
        F.count(F.lit(1)).alias("total_dags"),
        F.count_if(F.col("state") == "failed").alias("failed_runs"),
        F.count_if(F.col("state") == "success").alias("success_runs"),
    )
    task_part = t.agg(
        F.count_if(F.col("state") == "failed").alias("total_task_failures"),
        F.coalesce(F.round(F.avg("duration_sec"), 2), F.lit(0.0)).alias("avg_task_duration_sec"),
    )
    return combine_rows(dag_part, task_part)


def pipeline_failure_rate(runs: DataFrame, dags: DataFrame | None = None) -> DataFrame:
    """Failed last runs / max(1, DAGs) in %, two decimals."""
    last = _known_dags(runs, dags).join(last_runs(runs), "dag_id", "left")
    return last.agg(
        F.round(F.count_if(F.col("state") == "failed").cast("double")
                / F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double") * F.lit(100.0), 2).alias(
            "dag_failure_rate_pct")
    )


# ---------------------------------------------------------------------------
# Lake inventory
# ---------------------------------------------------------------------------

def list_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Files under ``root`` (recursive) as (path, modificationTime, length).

    Uses the binaryFile source with only metadata columns selected, so file
    contents are never read.  Folders starting with '_' or '.' are hidden
    by Spark's file index, as in the studied discovery walk.
    """
    try:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", glob).load(root))
    except Exception as exc:  # noqa: BLE001 - missing root: empty listing
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return df.select("path", "modificationTime", "length")


def folder_exists(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether ``path`` exists.  The file system is asked for the
    path itself; nothing is listed."""
    return spark.range(1).select(F.lit(path_exists(spark, path)).alias("present"))


def zone_inventory(spark: SparkSession, root: str, fmt: str = "json", sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(one-row counts of the ``fmt`` files, their paths in path order).

    ``sample`` keeps the first paths only (off by default)."""
    files = list_files(spark, root, f"*.{fmt}")
    counts = files.agg(F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    paths = files.select("path").orderBy("path")
    return counts, paths if sample is None else paths.limit(sample)


def lake_health(spark: SparkSession, processed_roots: Sequence[str], reports_root: str, anomalies_root: str | None = None,
                fmt: str = "json", zones: Sequence[str] = S.REPORT_ZONES) -> DataFrame:
    """One row: processed files of the lake's format, whether each report zone
    and the anomaly folder exist, and whether there are events at all."""
    parts = []
    for k, root in enumerate(processed_roots):
        parts.append(zone_inventory(spark, root, fmt)[0].select(F.col("file_count").alias(f"_n{k}"), F.col("bytes").alias(f"_b{k}")))
    for zone in zones:
        parts.append(folder_exists(spark, f"{reports_root.rstrip('/')}/{zone}").select(F.col("present").alias(f"{zone}_present")))
    if anomalies_root:
        parts.append(folder_exists(spark, anomalies_root).select(F.col("present").alias("anomalies_present")))
    one = combine_rows(*parts)
    n = sum((F.col(f"_n{k}") for k in range(len(processed_roots))), F.lit(0).cast("long"))
    size = sum((F.col(f"_b{k}") for k in range(len(processed_roots))), F.lit(0).cast("long"))
    shown = [c for c in one.columns if not c.startswith("_")]
    return one.select(n.alias("file_count"), size.alias("bytes"), *shown, (n > 0).alias("overall_healthy"))


def report_coverage(reports: DataFrame) -> DataFrame:
    """Loaded reports out of the catalogue: rows (name, loaded boolean)."""
    return reports.agg(
        F.count_if(F.col("loaded")).alias("loaded_reports"), F.count(F.lit(1)).alias("catalogued_reports")
    )

