"""A lake bucketed by page (E10, K11): page reports and windows without a shuffle.

Events are stored in two tables:

* ``pages``: rows in buckets of (page_title, page_wiki), the page keys with
  their defaults.  Spark reads a bucket as one partition and knows that a page
  lies in one bucket, so that grouping or windowing by page needs no exchange.
* ``hot``: the rows of pages with more than ``hot_rows`` rows in a batch.  A
  bucket is read by one task, and no page of that size may land in one; these
  rows have no layout and go through the shuffled, salted forms.

A page's rows are all in one of the two.  It becomes hot in the first batch that
has it, or never; one that grows slowly to more than ``hot_rows`` stays in its
bucket, until the lake is written anew from ``events()``.

A batch is visible once its manifest is (``sinks.published``).  Its rows carry
the name of the attempt that wrote them, so those of a run that died are never
read, and a batch id that is committed adds nothing.

Size ``buckets`` to the narrow columns that page reports read, some 256 MB of
them each; files number ``buckets`` a batch at most.  The catalog holds the
bucket layout: a session whose catalog does not know the tables registers them
again over the files (``PageLake.open``).

Special cases: null and empty titles and wikis are the page keys' defaults; an
empty batch is committed and adds no rows; repeated rows are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recentlake.functions import columns as C
from recentlake.sinks.published import Published

PAGE = ["page_title", "page_wiki"]
#: Rows of a page in one batch beyond which it is kept out of the buckets.
HOT_ROWS = 1_000_000
_ATTEMPT = "_attempt"


class PageLake:
    """The lake ``name`` (a catalog table name) under the folder ``root``."""

    def __init__(self, name: str, root: str, schema: T.StructType, buckets: int = 64, hot_rows: int = HOT_ROWS):
        self.name, self.root, self.buckets, self.hot_rows = name, root.rstrip("/"), buckets, hot_rows
        # Hive-style catalogs keep no nullability
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        self.log = Published(f"{self.root}/log")

    def _stored(self) -> T.StructType:
        strings = [T.StructField(c, T.StringType()) for c in (*PAGE, _ATTEMPT)]
        return T.StructType([*strings, *self.schema.fields])

    def open(self, spark: SparkSession) -> "PageLake":
        """Register the bucketed table over its files where the catalog lacks it."""
        if not spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._stored().fields)
            spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({', '.join(PAGE)}) "
                      f"INTO {self.buckets} BUCKETS LOCATION '{self.root}/pages'")
        return self

    # -- write ---------------------------------------------------------------

    def _hot_pages(self, spark: SparkSession) -> DataFrame:
        return self.log.read(spark, "hot_pages", ", ".join(f"{c} string" for c in PAGE))

    def append(self, events: DataFrame, batch_id: str | int) -> bool:
        """Store ``events`` as batch ``batch_id``; False when it is committed already."""
        spark = events.sparkSession
        self.open(spark)
        if str(batch_id) in self.log.batches(spark):
            return False
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        rows = events.select(C.page_title("title").alias(PAGE[0]), C.page_wiki("wiki").alias(PAGE[1]),
                             F.lit(attempt).alias(_ATTEMPT),
                             *(F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema.fields))
        # Pages over the bound: at most rows / hot_rows of them, by partial counts.
        large = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.hot_rows).select(*PAGE)
        known = self._hot_pages(spark)
        stored = self.pages(spark).join(large, PAGE, "left_semi").select(*PAGE).distinct()
        new = large.join(stored, PAGE, "left_anti").join(known, PAGE, "left_anti")
        staged = f"{self.root}/staged/{attempt}"
        new.write.parquet(staged)  # the decision is taken once; both tables follow it
        new = spark.read.schema(new.schema).parquet(staged)
        hot = known.unionByName(new)
        # The side of hot pages is small by its bound; AQE broadcasts it by its
        # measured size, or splits the skewed partitions of a sort-merge join.
        cold = rows.join(hot, PAGE, "left_anti")
        cold.select(*self._stored().names).repartition(self.buckets, *PAGE).sortWithinPartitions(*PAGE) \
            .write.mode("append").format("parquet").bucketBy(self.buckets, *PAGE).option("path", f"{self.root}/pages") \
            .saveAsTable(self.name)
        tables = {"hot": rows.join(hot, PAGE, "left_semi").select(*self._stored().names), "hot_pages": new,
                  "attempts": spark.range(1).select(F.lit(attempt).alias(_ATTEMPT))}
        return self.log.publish(tables, batch_id)

    # -- read ----------------------------------------------------------------

    def pages(self, spark: SparkSession) -> DataFrame:
        """Committed rows of the bucketed pages."""
        self.open(spark)
        # one short name for each committed batch
        names = [r[0] for r in self.log.read(spark, "attempts", f"{_ATTEMPT} string").collect()]
        return spark.table(self.name).where(F.col(_ATTEMPT).isin(names)).drop(_ATTEMPT)

    def hot(self, spark: SparkSession) -> DataFrame:
        """Committed rows of the hot pages."""
        return self.log.read(spark, "hot", self._stored()).drop(_ATTEMPT)

    def events(self, spark: SparkSession) -> DataFrame:
        """All committed rows, as they came."""
        return self.pages(spark).unionByName(self.hot(spark)).select(*(f"`{f.name}`" for f in self.schema.fields))
