"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on: UTC rendering of minute/hour buckets and
# ISO strings, the JSON parse of repeated keys.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key is valid; its last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    app_name: str = "recentlake",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to roughly input bytes / 128 MB for the largest
    shuffle (AQE coalesces the small ones at run time).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf.update(REQUIRED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_session_conf(spark)
    return spark


def ensure_session_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the operators depend on."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system (HDFS, S3, ...): it is read
    from the session and never replaced, and its absence is an error.  In
    local mode (tests, one process) an unset folder becomes a new temporary one.
    """
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recentlake-checkpoint-")
        spark.conf.set(key, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def reuse(df: DataFrame) -> DataFrame:
    """Materialise a frame that several outputs read, cutting its lineage.

    Always a reliable checkpoint in the shared folder (it survives lost
    executors, unlike cached blocks); it runs the job of ``df`` at once.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
