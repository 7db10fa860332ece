"""Helpers of the training-data operators: table access, the shared folder,
written lineage cuts and vectorised word splitting.

Words are the runs of bytes other than ``0x20`` and ``0x09``-``0x0D`` of the
UTF-8 text (the pattern ``[^\\x20\\x09-\\x0D]+``).  UTF-8 continuation bytes
never fall into that range, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

#: Rows of one Arrow batch sent to Python, so that a run of very long texts
#: stays within a worker's memory.
BATCH_ROWS = 1000
#: Text bytes that the vectorised helpers handle at once.
BLOCK_BYTES = 2 << 20

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# -- tables and the shared folder ------------------------------------------


def python_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch for the operators that handle whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    python_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode without that
    setting (tests) a new temporary folder, which is then the setting."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="recentlake-shared-")
        spark.conf.set(key, root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: a lineage cut that
    outlives lost executors.  Its path is added to ``paths``, for ``discard``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask for the shuffle files of frames that were written and are no longer
    used: Spark deletes them when the driver has collected their handles, which
    takes a second round for what the first one lets go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def spread(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- files by URI, for executors --------------------------------------------


def open_fs(uri: str):
    """File system and path of a URI (``file``, ``hdfs``, ``s3``, ``gs``)."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> None:
    """Write ``parts`` (bytes) to ``uri``: a private name first, then renamed,
    so that a repeated or speculative task leaves one whole file."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    files.move(draft, path)


# -- 64-bit mixing -------------------------------------------------------------

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(h: np.ndarray) -> np.ndarray:
    """The MurmurHash3 finaliser on an array."""
    h = h ^ (h >> _S33)
    h *= _C1
    h ^= h >> _S33
    h *= _C2
    h ^= h >> _S33
    return h


def random64(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32))
                     * np.uint64(0x9E3779B97F4A7C15))


#: One odd factor for each place of a word window.
WINDOW_FACTORS = random64(256, 3) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(max(1, n) - 1, np.uint64(0x2545F4914F6CDD1D)))
    return out


def byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACE_BYTES = byte_set(b" \t\n\x0b\x0c\r")
_BYTE_VALUES = random64(256, 11) | np.uint64(1)
#: A-Z count as a-z.
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[ord("A"):ord("Z") + 1] = _BYTE_VALUES[ord("a"):ord("z") + 1]


# -- vectorised splitting ------------------------------------------------------


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` for runs of rows of about
    ``block_bytes``; a row is never cut and null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes, side="right")) - 1)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def runs(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separator bytes (none crosses a
    row), and the index of each row's first run, with their number last."""
    n = len(data)
    inside = ~separators[data]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:] - 1] = False
    if n:
        after[-1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each run (with ``lower``, of A-Z as a-z)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first, last = int(starts[0]), int(ends[-1])
    part = data[first:last]
    spans = np.diff(np.append(starts, last))
    place = np.arange(last - first) - np.repeat(starts - first, spans)
    outside = place >= np.repeat(sizes, spans)
    place[outside] = 0
    values = (_LOWER_VALUES if lower else _BYTE_VALUES)[part]
    values *= _powers(int(sizes.max()))[place]
    values[outside] = 0
    out = np.add.reduceat(values, starts - first)
    return mix64(out + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window of ``size`` words that begins at each word, and
    whether that window lies within one row."""
    n = len(hashes)
    ok = np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    if n >= size:
        m = n - size + 1
        for j in range(size):
            out[:m] += hashes[j:j + m] * WINDOW_FACTORS[j]
        out[:m] = mix64(out[:m])
        left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
        ok = left >= size
    return out, ok


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


class HashIndex:
    """Positions of 64-bit keys in a sorted table, by their leading bits."""

    BITS = 20

    def __init__(self, table: np.ndarray):
        self.table = np.append(table, np.uint64(0))
        head = (table >> np.uint64(64 - self.BITS)).astype(np.int64)
        self.start = np.searchsorted(head, np.arange(1 << self.BITS)).astype(np.int32)
        self.most = int(np.bincount(head, minlength=1).max(initial=0))
        self.n = len(table)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        at = self.start[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)]
        out = np.where(self.table[at] == keys, at, -1)
        out[at == self.n] = -1
        missing = np.flatnonzero((out < 0) & (self.table[at] < keys))
        for k in range(1, self.most):
            place = np.minimum(at[missing] + k, self.n)
            hit = (self.table[place] == keys[missing]) & (place < self.n)
            out[missing[hit]] = place[hit]
            missing = missing[~hit & (self.table[place] < keys[missing]) & (place < self.n)]
        return out


def words_column(text="text"):
    """The words of a text as an array column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_SEPARATORS), lambda w: w != "")


def n_words_column(text="text"):
    """Number of words, without building the words of blank ends."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_SEPARATORS))).cast("long")
