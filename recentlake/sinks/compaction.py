"""Compaction of a stream sink's small files (K1).

The sink's folder is left alone: its metadata log stays the list of what the
stream has committed, and the stream may go on meanwhile.  Each compaction
reads the committed files that no earlier one has read, writes their rows in
few files (by ``event_date`` where the lake is partitioned) to a
:class:`Published` folder, and commits them together with the list of the
files that they replace.  Readers take the compacted rows and the committed
files that are not on that list, so every row is read once at any time.
Files on the list may be deleted by a retention job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recentlake.sinks.published import Published
from recentlake.sources.files import path_exists


class CompactedLake:
    """The lake that a stream sink writes to ``source``, compacted under ``root``."""

    def __init__(self, source: str, root: str, schema: T.StructType, fmt: str = "parquet", partition_by: tuple[str, ...] = ()):
        self.source, self.schema, self.fmt, self.by = source, schema, fmt, partition_by
        self.store = Published(root, fmt)

    def _files(self, spark: SparkSession) -> list[str]:
        """Files that the stream has committed and that are not compacted.  The
        listing is the driver's, as for every read of the folder."""
        if not path_exists(spark, self.source):
            return []
        committed = spark.read.schema(self.schema).format(self.fmt).load(self.source).inputFiles()
        done = {r["path"] for r in self.store.read(spark, "files", "path string").collect()}
        return sorted(set(committed) - done)

    def _open(self, spark: SparkSession, files: list[str]) -> DataFrame:
        if not files:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).format(self.fmt).option("basePath", self.source).load(files).select(*self.schema.names)

    def compact(self, spark: SparkSession, batch_id: str) -> int:
        """Number of files that were replaced."""
        files = self._files(spark)
        if not files or batch_id in self.store.batches(spark):
            return 0
        # rows of a day meet, and AQE cuts large days into files of its advisory size
        rows = self._open(spark, files).hint("rebalance", *(F.col(c) for c in self.by))
        replaced = spark.createDataFrame([(f,) for f in files], "path string")
        self.store.publish({"rows": rows, "files": replaced}, batch_id, partition_by={"rows": self.by})
        return len(files)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows that the stream has committed."""
        return self.store.read(spark, "rows", self.schema).select(*self.schema.names).unionByName(self._open(spark, self._files(spark)))
