"""Lake readers (S2-S10, S17): explicit schemas, no inference, no driver loops.

Every reader returns a lazy DataFrame; file discovery is Spark's file index
(recursive listing, hidden '_'/'.' entries skipped), so the listing of a
large lake is distributed and partition pruning applies to partitioned
layouts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recentlake import schema as S
from recentlake.functions import columns as C


def _missing(exc: Exception) -> bool:
    text = str(exc)
    return "PATH_NOT_FOUND" in text or "does not exist" in text or "Path does not exist" in text


def read_raw_events(spark: SparkSession, path: str, streaming: bool = False,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw feed lines (one JSON text per line), blank keep-alive lines removed."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path)
    return lines.filter(F.length(F.trim(F.col("value"))) > 0)


PARTITIONED = T.StructType(S.PROCESSED.fields + [T.StructField("event_date", T.DateType())])


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
                   with_file: bool = False, recursive: bool = True, partitioned: bool = False,
                   since: str | None = None, until: str | None = None) -> DataFrame:
    """Processed events with the fixed ``PROCESSED`` schema (never inferred).

    ``fmt='json'`` reads JSON lines; bad lines give all-null rows in
    PERMISSIVE mode (``load_events`` drops and counts them).
    ``with_file`` adds ``source_file`` from the file metadata column.

    ``partitioned=True`` reads a lake written with ``partition_by=
    ("event_date",)``: the partition column is discovered from the folder
    names and ``since``/``until`` (inclusive 'YYYY-MM-DD') prune whole
    folders before any file is opened (PartitionFilters in the plan).
    """
    schema = PARTITIONED if partitioned else S.PROCESSED
    reader = (spark.readStream if streaming else spark.read).schema(schema).format(fmt)
    if recursive and not streaming and not partitioned:
        reader = reader.option("recursiveFileLookup", "true")
    if fmt == "json":
        reader = reader.option("pathGlobFilter", "*.json")
    df = reader.load(path)
    if partitioned and since:
        df = df.filter(F.col("event_date") >= F.to_date(F.lit(since)))
    if partitioned and until:
        df = df.filter(F.col("event_date") <= F.to_date(F.lit(until)))
    if with_file:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = S.PROCESSED,
                    keep_corrupt: bool = False) -> DataFrame:
    """JSON lines with bad lines dropped (or kept in ``_corrupt_record``).

    Blank lines are skipped by the JSON source.  With ``keep_corrupt`` the
    undecodable lines stay as rows with ``_corrupt_record`` set, so they can
    be counted or quarantined instead of silently lost.
    """
    if keep_corrupt:
        full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        return (spark.read.schema(full).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_tree(spark: SparkSession, root: str, schema: T.StructType = S.PROCESSED) -> DataFrame:
    """All ``*.json`` files under ``root`` (recursive), with their path."""
    df = (spark.read.schema(schema).option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json").json(root))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def latest_files(df: DataFrame, n: int) -> DataFrame:
    """Rows of the ``n`` last files, by path order of ``source_file``.

    The distinct file list is reduced with a top-n; the row filter is a
    left-semi join against those paths (Spark broadcasts them by size).
    """
    keep = df.select("source_file").distinct().orderBy(F.col("source_file").desc()).limit(n)
    return df.join(keep, "source_file", "left_semi").select(*df.columns)


def read_first_available(spark: SparkSession, paths: Sequence[str],
                         reader: Callable[[SparkSession, str], DataFrame]) -> tuple[DataFrame | None, str | None]:
    """First path whose read yields data (primary zone, then legacy)."""
    for path in paths:
        try:
            df = reader(spark, path)
        except Exception as exc:  # noqa: BLE001
            if _missing(exc):
                continue
            raise
        if not df.isEmpty():
            return df, path
    return None, None


def file_version() -> Column:
    """A number of the file being read and its state: path, time of change and
    length, as the listing has them."""
    m = F.col("_metadata")
    return F.xxhash64(m["file_path"], m["file_modification_time"], m["file_size"])


def list_files(spark: SparkSession, roots: Sequence[str], glob: str = "*.json") -> DataFrame:
    """``path, version`` of the files under ``roots``, from their listing
    alone: no file is opened."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
              .load([r for r in roots if path_exists(spark, r)] or []))
    return listed.select("path", file_version().alias("version"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system has ``path``: one call, no listing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def open_files(spark: SparkSession, paths: Sequence[str], fmt: str = "json") -> DataFrame:
    """Processed events of just these files, with their ``version``."""
    if fmt == "json":
        return _json_events(spark, list(paths), False, None, None, "*", version=True).filter("line_ok").drop("line_ok", "source_file")
    return spark.read.schema(S.PROCESSED).format(fmt).load(list(paths)).select("*", file_version().alias("version"))


def _json_events(spark: SparkSession, root: str | list[str], partitioned: bool, since: str | None, until: str | None,
                 glob: str, version: bool = False) -> DataFrame:
    """Every non-blank line of the JSON files under ``root``: ``line_ok`` and
    the event's columns (null on a line that is no JSON object).

    Lines are read as text and parsed here, so that a count of good or bad
    lines sees the same rows as a report does.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    if partitioned:
        reader = reader.schema("value string, event_date date")
    else:
        reader = reader.option("recursiveFileLookup", "true")
    lines = reader.format("text").load(root)
    if partitioned and since:
        lines = lines.filter(F.col("event_date") >= F.to_date(F.lit(since)))
    if partitioned and until:
        lines = lines.filter(F.col("event_date") <= F.to_date(F.lit(until)))
    full = T.StructType([*S.PROCESSED.fields, T.StructField("_corrupt", T.StringType())])
    rec = F.from_json(F.col("value"), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    line = F.struct(rec.alias("r"), C.is_json_object_text("value").alias("o"))
    # A generator of one element: the optimizer copies no parse into the uses
    # of its columns, so each line is parsed once.
    one = F.filter(F.array(F.when(F.length(C.strip_ws("value")) > 0, line)), lambda x: x.isNotNull())
    more = ["event_date"] if partitioned else []
    if version:
        lines = lines.select("value", "_metadata", file_version().alias("version"))
        more = [*more, "version"]
    parsed = lines.select(F.explode(one).alias("_p"), F.col("_metadata.file_path").alias("source_file"), *more)
    ok = F.col("_p.o") & F.col("_p.r").isNotNull() & F.col("_p.r._corrupt").isNull()
    return parsed.select(ok.alias("line_ok"), *(F.col(f"_p.r.{f.name}").alias(f.name) for f in S.PROCESSED.fields),
                         "source_file", *more)


def _zone(spark: SparkSession, root: str, fmt: str, partitioned: bool, since: str | None, until: str | None,
          glob: str) -> DataFrame | None:
    """One folder of the lake with ``line_ok``; None when it does not exist."""
    try:
        if fmt == "json":
            return _json_events(spark, root, partitioned, since, until, glob)
        df = read_processed(spark, root, fmt=fmt, with_file=True, partitioned=partitioned, since=since, until=until)
        return df.select(F.lit(True).alias("line_ok"), *(f.name for f in S.PROCESSED.fields), "source_file",
                         *(["event_date"] if partitioned else []))
    except Exception as exc:  # noqa: BLE001
        if _missing(exc):
            return None
        raise


def lake_lines(spark: SparkSession, roots: str | Sequence[str], legacy_root: str | None = None, fmt: str = "json",
               partitioned: bool = False, since: str | None = None, until: str | None = None,
               glob: str = "*.json") -> DataFrame:
    """All lines of the lake folders ``roots`` with ``line_ok``; the legacy
    folder is read only when none of them exists or has rows."""
    wanted = [roots] if isinstance(roots, str) else list(roots)
    found = [z for z in (_zone(spark, r, fmt, partitioned, since, until, glob) for r in wanted) if z is not None]
    if legacy_root and all(z.isEmpty() for z in found):
        legacy = _zone(spark, legacy_root, fmt, partitioned, since, until, glob)
        found = [legacy] if legacy is not None else found
    if not found:
        return spark.createDataFrame([], T.StructType([
            T.StructField("line_ok", T.BooleanType()), *S.PROCESSED.fields, T.StructField("source_file", T.StringType())]))
    out = found[0]
    for z in found[1:]:
        out = out.unionByName(z)
    return out


def load_events(spark: SparkSession, roots: str | Sequence[str], legacy_root: str | None = None, fmt: str = "json",
                max_files: int | None = None, partitioned: bool = False, since: str | None = None,
                until: str | None = None, glob: str = "*.json") -> DataFrame:
    """Processed events of the lake with ``source_file`` (for files_read).

    Lines that do not decode to a JSON object are no events: they are
    skipped (``skipped_lines`` counts them).  ``roots`` may name several
    folders, one for each writer.  ``max_files`` keeps only the last files by
    path order (the studied pipeline's optional cap; no cap by default).
    With a date-partitioned lake, ``since``/``until`` restrict the read.
    """
    df = lake_lines(spark, roots, legacy_root, fmt, partitioned, since, until, glob)
    df = df.filter("line_ok").drop("line_ok")
    return df if max_files is None else latest_files(df, max_files)


def skipped_lines(spark: SparkSession, roots: str | Sequence[str], legacy_root: str | None = None, fmt: str = "json",
                  partitioned: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row: lines of the lake that are no events."""
    lines = lake_lines(spark, roots, legacy_root, fmt, partitioned, since, until)
    return lines.agg(F.count_if(~F.col("line_ok")).alias("skipped_lines"))


def load_anomalies(spark: SparkSession, root: str) -> DataFrame:
    """All stored anomalies of every run, with their ``run``.

    Reads the run folders of ``sinks.write_anomaly_run`` (JSON lines, one
    anomaly a line), and documents of the studied pipeline: an object with an
    ``anomalies`` list, or a bare list, over one or more lines of a file.  The
    '_summary' folder is hidden from the listing; a missing root gives an
    empty frame.
    """
    schema = T.StructType(S.ANOMALY.fields + [T.StructField("run", T.StringType())])
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    children = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)  # one level: runs and documents
    names = sorted(c.getPath().getName() for c in children)
    runs = any(n.startswith("run=") for n in names)
    documents = [f"{root.rstrip('/')}/{n}" for n in names if not n.startswith(("run=", "_", "."))]
    parts = []
    if runs:
        parts.append(_anomaly_lines(spark, f"{root.rstrip('/')}/run=*"))
    if documents:
        parts.append(_anomaly_documents(spark, documents))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _anomaly_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Stored runs: one anomaly a line, split like any text; broken lines are skipped."""
    lines = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(pattern)
    run = F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1)
    rows = lines.select(F.from_json("value", S.ANOMALY).alias("a"), run.alias("run")).filter(F.col("a.type").isNotNull())
    return rows.select(*(F.col(f"a.{c}").alias(c) for c in S.ANOMALY_COLUMNS), "run")


def _anomaly_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Foreign documents, which may span lines: whole small files, one row each."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(paths, wholetext=True)
    text = C.strip_ws("value")
    run = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "[.]json$", "")
    # Every form becomes the text of one JSON list, parsed once.
    lines = F.filter(F.split(text, "\n"), lambda x: F.try_parse_json(x).isNotNull())
    listed = F.when(text.startswith("["), text).otherwise(
        F.coalesce(F.get_json_object(text, "$.anomalies"), F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))))
    parsed = whole.select(listed.alias("_list"), run.alias("run")).select("run", F.from_json("_list", T.ArrayType(S.ANOMALY)).alias("_rows"))
    one = parsed.select(F.explode("_rows").alias("a"), "run").filter(F.col("a.type").isNotNull())
    return one.select(*(F.col(f"a.{c}").alias(c) for c in S.ANOMALY_COLUMNS), "run")


def load_reports(spark: SparkSession, catalog: dict[str, str]) -> DataFrame:
    """Report catalogue: (name, path, loaded, generated_at) per entry.

    Each report is a small JSON document; it is read as text and its
    ``generated_at`` extracted.  Missing files give ``loaded = false``.
    """
    rows = []
    for name, path in catalog.items():
        try:
            doc = spark.read.text(path, wholetext=True).select(
                F.lit(name).alias("name"), F.lit(path).alias("path"), F.lit(True).alias("loaded"),
                F.get_json_object("value", "$.generated_at").alias("generated_at"))
        except Exception as exc:  # noqa: BLE001
            if not _missing(exc):
                raise
            doc = spark.createDataFrame([(name, path, False, None)],
                                        "name string, path string, loaded boolean, generated_at string")
        rows.append(doc)
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def latest_generated_at(reports: DataFrame) -> DataFrame:
    """Newest parseable ``generated_at`` among loaded reports."""
    ts = F.try_to_timestamp(C.nonempty(C.strip_ws("generated_at")))
    return reports.agg(F.max(ts).alias("latest_generated_at"))
