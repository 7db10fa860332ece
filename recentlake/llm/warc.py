"""WARC archives with a two-level capture index (operator 4).

Writing: every page becomes a gzip member of a WARC file in the shared folder.
Of pages with equal payloads the one with the largest ``page_id`` is stored as
``response``; the others become ``revisit`` records that name it.  The choice
is made on digests only, so page bodies are shuffled once, by ``page_id``,
however many copies a payload has.

Index: captures are range-sorted by their reversed-host URL key
(``com,example)/path``) and packed into zlib blocks of ``BLOCK_LINES`` lines.
Beside each block file lies its sparse directory (first key, offset, length of
every block), and the table of parts has the first key of each block file.
A lookup binary-searches the parts, then the directory, reads the blocks that
may hold its keys by range, each once for a sorted run of keys, and then the
records by range.

Every WARC file begins with a ``warcinfo`` record.  A record's id is a UUID of
its file and place, so ids are unique whatever the pages hold; the page's id
and the one that a revisit refers to have fields of their own.  File names
carry the task attempt, so that a repeated or speculative task never replaces
the file that the captures of the winning attempt point into.

Special cases: null or empty html is an empty payload (all such pages are
equal payloads as long as ``min_bytes`` is 0), a null URL has the empty key, a
null ``page_id`` ranks below all others, rows equal in ``page_id`` and
payload are stored alike, an empty table gives an archive without files and
an empty result.  Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import open_fs, saved, shared_path, spread, write_file

BLOCK_LINES = 1000
#: Bytes of records in one WARC file, about.
FILE_BYTES = 32 << 20
#: The archive has no clock of its own: records carry a fixed date.
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """``records``: one row per record (file, place, URL key); ``parts``: one
    row per index block file, with its first key."""

    records: DataFrame
    parts: DataFrame


def url_key(url: str | None) -> str:
    """Reversed host, then path and query, lower case host and no scheme:
    ``http://www.Example.com/a?b`` is ``com,example,www)/a?b``."""
    if not url:
        return ""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url)
    host, slash, path = rest.partition("/")
    path = (slash + path).split("#", 1)[0] or "/"
    host = host.split("#", 1)[0]
    host, mark, query = host.partition("?")
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + path + mark + query


# -- records ---------------------------------------------------------------------


def record_id(file: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{place}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _member(head: list[str], body: bytes) -> bytes:
    raw = "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def info_bytes(file: str) -> bytes:
    """The ``warcinfo`` record that begins a file."""
    return _member([
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(file, 0)}", f"WARC-Date: {DATE}",
        f"WARC-Filename: {file.rsplit('/', 1)[-1]}", "Content-Type: application/warc-fields",
    ], b"software: recentlake\r\nformat: WARC File Format 1.1\r\n")


def record_bytes(page_id, url: str | None, payload: bytes, refers_to, refers_url: str | None = None,
                 file: str = "", place: int = 0) -> bytes:
    """One WARC record as a gzip member for ``place`` of ``file``; a revisit
    has no body and names the page and URL of the response."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(file, place)}",
        f"WARC-Warcinfo-ID: {record_id(file, 0)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + _uri(url))
    if revisit:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Profile: {REVISIT_PROFILE}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    return _member([*head, "Content-Type: text/html; charset=utf-8"], body)


def parse_record(member: bytes) -> dict:
    """Headers and body of a page's gzip member; the body's digest is verified."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"record of page {page}: payload digest differs")
    return {
        "page_id": None if page is None else int(page), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest,
        "refers_to": None if refers is None else int(refers), "body": body,
    }


# -- writing ---------------------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to, refers_url`` of the pages that repeat a payload."""
    digests = pages.select("page_id", F.col("url").cast("string").alias("url"), F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("digest"),
                           F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("n"))
    digests = digests.where(F.col("n") >= min_bytes)
    winners = digests.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.max(F.struct("page_id", "url"))["url"].alias("refers_url"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return digests.join(winners, "digest").where(
        F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull())) \
        .select("page_id", "digest", "refers_to", "refers_url").distinct()


def write_archive(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES) -> Archive:
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    body = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to", "refers_url")
    chosen = body.join(
        again, F.col("page_id").eqNullSafe(F.col("__p")) & (F.sha1(F.col("html").cast("binary")) == F.col("__d")), "left"
    ).select("page_id", "url", "html", "refers_to", "refers_url")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/records-{task.partitionId():06d}-{task.taskAttemptId()}"
        number, file, held, size, rows = 0, "", [], 0, []

        def flush():
            nonlocal number, held, size
            write_file(file, held)
            number, held, size = number + 1, [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url")]
            for page, url, html, refers, refers_url in zip(*columns, strict=True):
                if not held:
                    file = f"{name}-{number:06d}.warc.gz"
                    held = [info_bytes(file)]
                    size = len(held[0])
                member = record_bytes(page, url, html.encode("utf-8"), refers, refers_url, file, size)
                rows.append((url_key(url), page, file, size, len(member)))
                held.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    flush()
            if rows:
                yield _batch(rows, _PLACE)
                rows = []
        if held:
            flush()

    records = saved(chosen.mapInArrow(write, "url_key string, page_id bigint, file string, place bigint, length bigint"), "captures")
    return Archive(records, write_index(records, f"{folder}/index", block_lines))


_PLACE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("length", pa.int64())])
_PART = pa.schema([("part", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("blocks", pa.int64()), ("lines", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def write_index(records: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks and directories of all records; returns the table of parts."""
    order = ["url_key", "page_id", "file", "place"]
    ranged = records.select(*order, "length").repartitionByRange(spread(records.sparkSession), *order) \
        .sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        packed, directory, held, at, first, last, lines = [], [], [], 0, None, None, 0

        def flush():
            nonlocal held, at
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in held).encode())
            directory.append((held[0][0], at, len(block)))
            packed.append(block)
            at, held = at + len(block), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = row[0] if first is None else first
                last, lines = row[0], lines + 1
                held.append(row)
                if len(held) >= block_lines:
                    flush()
        if held:
            flush()
        if directory:
            write_file(f"{name}.blocks", packed)
            write_file(f"{name}.directory", [json.dumps(directory, ensure_ascii=False).encode()])
            yield _batch([(name, first, last, len(directory), lines)], _PART)

    return saved(ranged.mapInArrow(write, "part string, first_key string, last_key string, blocks bigint, lines bigint"), "parts")


# -- reading ---------------------------------------------------------------------


def _read_range(uri: str, at: int, length: int) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as source:
        return source.read_at(length, at)


def _directory(part: str) -> list[list]:
    files, path = open_fs(f"{part}.directory")
    with files.open_input_file(path) as source:
        return json.loads(source.read())


def _block(part: str, at: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(_read_range(f"{part}.blocks", at, length)).decode().split("\n")]


def index_entries(parts: DataFrame) -> DataFrame:
    """All captures, read from the index block by block."""

    def read(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                for _, at, length in _directory(part):
                    yield _batch([tuple(x) for x in _block(part, at, length)], _PLACE)

    return parts.select("part").repartition(spread(parts.sparkSession), "part").mapInArrow(
        read, "url_key string, page_id bigint, file string, place bigint, length bigint")


_RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_records(entries: DataFrame, with_body: bool = False) -> DataFrame:
    """The records at ``file, place, length``: each file is opened once by a
    task and its records are read by range in file order."""
    schema = _RECORD + (", body binary" if with_body else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[x.strip().split(" ")[1]]) for n, x in zip(names, schema.split(","), strict=True)])

    def read(batches):
        uri, source = None, None
        for batch in batches:
            rows = []
            for name, place, length in zip(*(batch.column(c).to_pylist() for c in ("file", "place", "length")), strict=True):
                if name != uri:
                    if source is not None:
                        source.close()
                    files, path = open_fs(name)
                    uri, source = name, files.open_input_file(path)
                record = parse_record(source.read_at(length, place))
                rows.append(tuple(record[n] for n in names))
            if rows:
                yield _batch(rows, arrow)
        if source is not None:
            source.close()

    # Runs of a file of about a MB each, so that one file's records may go to several tasks.
    run = F.floor(F.col("place") / F.lit(1 << 20))
    placed = entries.select("file", "place", "length").repartition(spread(entries.sparkSession), F.col("file"), run)
    return placed.sortWithinPartitions("file", "place").mapInArrow(read, schema)


def read_captures(archive: Archive, with_body: bool = False) -> DataFrame:
    """Every record of the archive, found through the index."""
    return read_records(index_entries(archive.parts), with_body)


class PartSearch:
    """Entries of ascending keys in one index block file: the sparse directory
    is binary-searched, and only the blocks that may hold a key are read, each
    once for a run of keys that it holds."""

    def __init__(self, part: str):
        self.part, self.directory = part, _directory(part)
        self.firsts = [d[0] for d in self.directory]
        self.number, self.lines, self.keys, self.blocks_read = None, [], [], 0

    def _load(self, number: int) -> None:
        if number != self.number:
            self.lines = _block(self.part, *self.directory[number][1:])
            self.keys = [x[0] for x in self.lines]
            self.number, self.blocks_read = number, self.blocks_read + 1

    def find(self, key: str):
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.firsts) and self.firsts[at] <= key:
            self._load(at)
            yield from map(tuple, self.lines[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)])
            at += 1


def lookup(archive: Archive, urls: DataFrame, with_body: bool = True) -> DataFrame:
    """The captures of ``urls`` (column ``url``), by binary search.

    The distinct keys are searched in the table of parts, go to the parts that
    may hold them in sorted runs, and are searched there (:class:`PartSearch`).
    A key that fills several parts goes to each of them.
    """
    spark = urls.sparkSession

    def keys(batches):
        for batch in batches:
            found = sorted({url_key(u) for u in batch.column("url").to_pylist()})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["key"])

    wanted = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(keys, "key string").distinct()
    # The first keys, one for each block file of the index, are its top level.
    tops = sorted((r["first_key"], r["last_key"], r["part"]) for r in archive.parts.select("first_key", "last_key", "part").collect())
    firsts = [t[0] for t in tops]

    def route(batches):
        for batch in batches:
            rows = []
            for k in batch.column("key").to_pylist():
                at = max(0, bisect.bisect_left(firsts, k) - 1)
                while at < len(tops) and tops[at][0] <= k:
                    if tops[at][1] >= k:
                        rows.append((tops[at][2], k))
                    at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["part", "key"])

    def search(batches):
        held = None
        for batch in batches:
            rows = []
            for part, k in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if held is None or held.part != part:
                    held = PartSearch(part)
                for entry in held.find(k):
                    rows.append(entry)
                    if len(rows) >= BLOCK_LINES:
                        yield _batch(rows, _PLACE)
                        rows = []
            if rows:
                yield _batch(rows, _PLACE)

    routed = wanted.mapInArrow(route, "part string, key string").repartition(spread(spark), "part").sortWithinPartitions("part", "key")
    return read_records(routed.mapInArrow(search, "url_key string, page_id bigint, file string, place bigint, length bigint"), with_body)
