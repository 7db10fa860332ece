"""All-or-nothing tables (K3, K9, K10): staged write, numbered manifest.

A batch is written to folders of its own, ``data/<table>/_batch=<name>``, that
no reader knows.  Then one small manifest, ``_manifest/<number>.json``, which
names the folders of all committed batches, is renamed into place; the rename fails when another
writer took the number.  Readers open the folders of the highest manifest:

* a run that dies leaves a folder that no manifest names, and the state
  before it stays readable;
* a batch id that is committed already is not written again, so a replayed
  micro-batch or a repeated run adds nothing;
* several tables of one batch become visible together.

The driver handles the manifest only (a row for each batch since the last
compaction); the data is written and read by Spark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer committed meanwhile."""


class Published:
    """Named tables under ``root``, published batch by batch."""

    def __init__(self, root: str, fmt: str = "parquet"):
        self.root = root.rstrip("/")
        self.fmt = fmt

    # -- manifest ------------------------------------------------------------

    def _fs(self, spark: SparkSession, path: str):
        hadoop = spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def _newest(self, spark: SparkSession) -> tuple[int, list[dict]]:
        fs, folder = self._fs(spark, f"{self.root}/_manifest")
        if not fs.exists(folder):
            return 0, []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, []
        number = max(numbers)
        _, path = self._fs(spark, f"{self.root}/_manifest/{number:012d}.json")
        stream = fs.open(path)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return number, json.loads(text)

    def _commit(self, spark: SparkSession, number: int, entries: list[dict]) -> None:
        fs, draft = self._fs(spark, f"{self.root}/_manifest/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entries), "utf-8"))
        finally:
            out.close()
        _, path = self._fs(spark, f"{self.root}/_manifest/{number:012d}.json")
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"manifest {number} of {self.root} exists")

    def batches(self, spark: SparkSession) -> list[str]:
        """Committed batch ids, in order."""
        return [b for e in self._newest(spark)[1] for b in e["batches"]]

    def paths(self, spark: SparkSession, table: str) -> list[str]:
        """Committed folders of ``table``, in order."""
        return [self._path(table, e["name"]) for e in self._newest(spark)[1] if table in e["tables"]]

    def _path(self, table: str, name: str) -> str:
        return f"{self.root}/data/{table}/_batch={name}"

    # -- tables --------------------------------------------------------------

    def publish(self, tables: dict[str, DataFrame], batch_id: str | int, replace: bool = False,
                partition_by: dict[str, tuple[str, ...]] | None = None) -> bool:
        """Write ``tables`` as batch ``batch_id`` and make them visible at once;
        False when the batch is committed already.  ``replace`` makes them the
        only visible ones (older folders stay until ``vacuum``)."""
        spark = next(iter(tables.values())).sparkSession
        number, entries = self._newest(spark)
        batch = str(batch_id)
        if any(batch in e["batches"] for e in entries):
            return False
        name = f"{batch}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            writer = df.write.format(self.fmt)
            by = (partition_by or {}).get(table)
            (writer.partitionBy(*by) if by else writer).save(self._path(table, name))
        if replace:
            gone = [b for e in entries for b in e["batches"]]
            entries = [{"batches": gone, "name": None, "tables": []}] if gone else []
        entry = {"batches": [batch], "name": name, "tables": sorted(tables)}
        self._commit(spark, number + 1, [*entries, entry])
        return True

    def read(self, spark: SparkSession, table: str, schema: T.StructType | str) -> DataFrame:
        """Rows of ``table`` of all committed batches (empty when there are none)."""
        empty = spark.createDataFrame([], schema)
        paths = self.paths(spark, table)
        if not paths:
            return empty
        rows = spark.read.schema(schema).format(self.fmt).option("basePath", f"{self.root}/data/{table}").load(paths)
        return rows.select(*(f"`{c}`" for c in empty.columns))

    def rewrite(self, tables: dict[str, DataFrame]) -> bool:
        """Replace all committed folders by one batch with ``tables``, which
        hold their merged rows; the batch ids stay committed.  Readers that
        opened the old folders finish on them.  False when nothing is committed."""
        spark = next(iter(tables.values())).sparkSession
        number, entries = self._newest(spark)
        if not entries:
            return False
        name = f"merged-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.format(self.fmt).save(self._path(table, name))
        ids = [b for e in entries for b in e["batches"]]
        self._commit(spark, number + 1, [{"batches": ids, "name": name, "tables": sorted(tables)}])
        return True

    def vacuum(self, spark: SparkSession) -> int:
        """Delete folders that the newest manifest does not name, of dead runs
        and replaced batches; no run may be writing meanwhile.  Returns their number."""
        fs, data = self._fs(spark, f"{self.root}/data")
        if not fs.exists(data):
            return 0
        kept = {(t, e["name"]) for e in self._newest(spark)[1] for t in e["tables"]}
        gone = [(t.getPath().getName(), b.getPath()) for t in fs.listStatus(data) for b in fs.listStatus(t.getPath())]
        gone = [path for table, path in gone if (table, path.getName().removeprefix("_batch=")) not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
