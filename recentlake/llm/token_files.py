"""Token ids in binary shards (operator 6): a wavelet matrix per shard.

A shard holds the ids of consecutive documents as one bit-plane per id bit,
highest first.  Each plane is the stable partition of the one above: ids with
a zero bit first.  The planes hold ranks in the shard's own alphabet, the ids
that occur in it.  With a running count of ones per ``RANK_BLOCK`` bits, a
plane answers rank and select, and with them the shard answers

* ``access(positions)``: the ids at positions,
* ``count(token, end)``: occurrences before a position,
* ``occurrences(token)``: all positions of an id,

without unpacking the ids.  Documents are ordered by range partitioning on
``doc_id`` (nulls last); each task writes shards of about ``SHARD_IDS`` ids
in the shared folder, so what a task holds does not grow with the table.

Special cases: null and empty texts give the end id alone, equal ``doc_id``
rows are kept side by side in text order, an empty table writes no shard and
reads back as an empty result.  Columns other than ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recentlake.llm.common import open_fs, saved, shared_path, spread, write_file

END_ID = 2
SHARD_IDS = 4_000_000
#: Words whose ids a worker remembers.
MEMO_WORDS = 800_000

MAGIC = b"WMTX0001"
RANK_BLOCK = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- tokenizer ----------------------------------------------------------------


#: Rules of the tokenizer's own first cut, fixed values.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Words of these characters only are cut and lower-cased here just as the
#: tokenizer does it; others go to the library whole.
_PLAIN = re.compile(r"[\x21-\x7E\xA1-\u012F\u0131-\u024F]+")
_JOINED = 500


class _Numbers(dict):
    """Numbers words as they come up, and lists the new ones."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.fresh.append(word)
        return k


class _Runs:
    """Runs of ids, appended."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.n = 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        old = int(self.ends[self.n])
        while old + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[old:old + len(ids)] = ids
        self.ends[self.n + 1:self.n + 1 + len(sizes)] = old + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs ``at``, joined, and the bounds of each."""
        first = self.ends[at]
        sizes = self.ends[at + 1] - first
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(first - total[:-1], sizes) + np.arange(total[-1])], total


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The tokenizer drops white space, and none of its tokens spans white space
    or a change between letters, digits and other characters.  So a text's ids
    are those of its words, and a word's those of its parts, in order; the
    library encodes each distinct part once and the ids are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bits = max(1, int(self.tokenizer.get_vocab_size() - 1).bit_length())
        self.parts, self.part_ids = _Numbers(), _Runs()
        self._clear()

    def _clear(self) -> None:
        self.words, self.word_ids = _Numbers(), _Runs()
        if len(self.parts) > 2 * MEMO_WORDS:
            self.parts, self.part_ids = _Numbers(), _Runs()

    def _learn_parts(self) -> None:
        """Encode new parts, many in one string: each is one word of it."""
        fresh, self.parts.fresh = self.parts.fresh, []
        for lo in range(0, len(fresh), _JOINED):
            some = fresh[lo:lo + _JOINED]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            sizes = np.bincount(np.array(done.word_ids, np.int64), minlength=len(some))
            if len(sizes) != len(some) or not sizes.all():
                alone = self.tokenizer.encode_batch(some, add_special_tokens=False)
                sizes = np.array([len(x.ids) for x in alone], np.int64)
                ids = [i for x in alone for i in x.ids]
            else:
                ids = done.ids
            self.part_ids.append(np.array(ids, np.uint32), sizes)

    def _learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        number = self.parts.__getitem__
        at, sizes, odd = [], [], []
        for k, word in enumerate(fresh):
            text = word.decode("utf-8")
            if not (text.isascii() or _PLAIN.fullmatch(text)):
                odd.append(k)
                sizes.append(0)
            elif text.isalpha():
                at.append(number(text.lower()))
                sizes.append(1)
            elif text[:-1].isalpha():
                at += number(text[:-1].lower()), number(text[-1])
                sizes.append(2)
            elif _PLAIN.fullmatch(text) and not ("<|" in text and any(s in text for s in self.special)):
                cut = _PARTS.findall(text.lower())
                at += map(number, cut)
                sizes.append(len(cut))
            else:
                odd.append(k)
                sizes.append(0)
        self._learn_parts()
        ids, bounds = self.part_ids.take(np.array(at, np.int64))
        per_word = np.diff(bounds[np.concatenate([[0], np.cumsum(sizes)])])
        if odd:
            whole = [x.ids for x in self.tokenizer.encode_batch([fresh[k].decode("utf-8") for k in odd], add_special_tokens=False)]
            pieces = np.split(ids, np.cumsum(per_word)[:-1])
            for k, x in zip(odd, whole, strict=True):
                pieces[k] = np.array(x, np.uint32)
                per_word[k] = len(x)
            ids = np.concatenate(pieces)
        self.word_ids.append(ids, per_word)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, an end id after each, and the ids per text."""
        if len(self.words) > MEMO_WORDS:
            self._clear()
        split = [t.split() for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        if self.words.fresh:
            self._learn()
        ids, bounds = self.word_ids.take(at)
        per_text = np.diff(bounds[np.concatenate([[0], np.cumsum(n_words)])])
        out = np.full(len(ids) + len(texts), END_ID, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_text + 1) - 1] = False
        out[keep] = ids
        return out, per_text + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# -- wavelet matrix -------------------------------------------------------------


def build_planes(ids: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """``(zeros, packed bits, ones before each rank block)`` of each plane."""
    planes = []
    row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for shift in range(bits - 1, -1, -1):
        ones = (row & row.dtype.type(1 << shift)).astype(bool)
        packed = np.packbits(ones, bitorder="little")
        planes.append((int(len(ones) - ones.sum()), packed.tobytes(), _directory(packed).tobytes()))
        row = np.concatenate([row[~ones], row[ones]])
    return planes


def _directory(packed: np.ndarray) -> np.ndarray:
    size = RANK_BLOCK // 8
    counts = np.bitwise_count(np.append(packed, np.zeros(-len(packed) % size, np.uint8))).reshape(-1, size).sum(1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)]).astype(np.uint32)


def shard_bytes(ids: np.ndarray, bits: int, documents: bytes) -> list[bytes]:
    """The parts of a shard file; ``documents`` is its table of documents."""
    table = zlib.compress(documents)
    seen = np.zeros(1 << bits, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    rank = np.cumsum(seen, dtype=np.uint32) - np.uint32(1)
    bits = max(1, (len(alphabet) - 1).bit_length())
    parts = [MAGIC, struct.pack("<QIQQ", len(ids), bits, len(table), len(alphabet)), table, alphabet.tobytes()]
    for zeros, packed, directory in build_planes(rank[ids], bits):
        parts += [struct.pack("<QQQ", zeros, len(packed), len(directory)), packed, directory]
    return parts


class Shard:
    """A shard file: its documents table, and queries on its ids."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.bits, size, letters = struct.unpack_from("<QIQQ", content, 8)
        at = 8 + struct.calcsize("<QIQQ")
        self.documents = zlib.decompress(content[at:at + size])
        at += size
        self.alphabet = np.frombuffer(content, np.uint32, letters, at)
        at += 4 * letters
        self.planes = []
        for _ in range(self.bits):
            zeros, n_bits, n_dir = struct.unpack_from("<QQQ", content, at)
            at += 24
            packed = np.frombuffer(content, np.uint8, n_bits, at)
            directory = np.frombuffer(content, np.uint32, n_dir // 4, at + n_bits)
            self.planes.append((zeros, packed, directory))
            at += n_bits + n_dir

    def _letter(self, token: int) -> int | None:
        """Rank of a token in the alphabet, None if it doesn't occur."""
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _ones(self, plane: int, ends: np.ndarray) -> np.ndarray:
        """Ones of a plane before each of ``ends``."""
        _, packed, directory = self.planes[plane]
        block = ends // RANK_BLOCK
        counts = directory[block].astype(np.int64)
        size = RANK_BLOCK // 8
        inside = block[:, None] * size + np.arange(size)
        left = np.clip(ends[:, None] - inside * 8, 0, 8)
        masks = ((1 << left) - 1).astype(np.uint8)
        taken = packed[np.minimum(inside, max(0, len(packed) - 1))] if len(packed) else np.zeros(inside.shape, np.uint8)
        return counts + np.bitwise_count(taken & masks).sum(1, dtype=np.int64)

    def access(self, positions) -> np.ndarray:
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.uint32)
        for k in range(self.bits):
            zeros, packed, _ = self.planes[k]
            bit = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            ones = self._ones(k, at)
            at = np.where(bit == 1, zeros + ones, at - ones)
            out = (out << np.uint32(1)) | bit
        return self.alphabet[out] if len(out) else out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k in range(self.bits):
            zeros = self.planes[k][0]
            a, b = self._ones(k, np.array([lo, hi]))
            lo, hi = (zeros + a, zeros + b) if token >> (self.bits - 1 - k) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before position ``end``."""
        token = self._letter(token)
        if token is None:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of ``token``, ascending: select from the last plane up."""
        token = self._letter(token)
        if token is None:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(token, self.n), dtype=np.int64)
        for k in range(self.bits - 1, -1, -1):
            zeros, packed, directory = self.planes[k]
            one = token >> (self.bits - 1 - k) & 1
            ordinal = at - zeros if one else at
            ends = directory.astype(np.int64) if one else np.arange(len(directory)) * RANK_BLOCK - directory
            block = np.searchsorted(ends, ordinal, side="right") - 1
            size = RANK_BLOCK // 8
            bits = np.unpackbits(np.append(packed, np.zeros(-len(packed) % size, np.uint8)).reshape(-1, size)[block], axis=1, bitorder="little")
            places = np.cumsum(bits == one, axis=1, dtype=np.int64)
            at = block * RANK_BLOCK + (places <= (ordinal - ends[block])[:, None]).sum(1)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        row = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in range(self.bits - 1, -1, -1):
            zeros, packed, _ = self.planes[k]
            ones = np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)
            row[zeros:] |= row.dtype.type(1 << (self.bits - 1 - k))
            above = np.empty_like(row)
            above[~ones] = row[:zeros]
            above[ones] = row[zeros:]
            row = above
        return self.alphabet[row] if self.n else row.astype(np.uint32)


# -- writing and reading shards ------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write all documents' ids as shards; returns the manifest: one row per
    shard with ``file``, ``n_ids`` and ``n_docs``, files in document order."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    folder = shared_path(spark, "tokens")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    ranged = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .repartitionByRange(spread(spark), order[0]).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        part, number, files = TaskContext.get().partitionId(), 0, []
        own = encoder(path)
        held, table, size = [], [], 0

        def flush():
            nonlocal number, held, table, size
            uri = f"{folder}/{part:06d}-{number:06d}.wm"
            write_file(uri, shard_bytes(np.concatenate(held), own.bits, json.dumps(table).encode()))
            files.append((uri, size, len(table)))
            number, held, table, size = number + 1, [], [], 0

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 64):
                tokens, sizes = own.encode(texts[lo:lo + 64])
                held.append(tokens)
                table += zip(ids[lo:lo + 64], sizes.tolist(), strict=True)
                size += len(tokens)
                if size >= shard_ids:
                    flush()
        if size:
            flush()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["file", "n_ids", "n_docs"])

    return saved(ranged.mapInArrow(write, "file string, n_ids bigint, n_docs bigint"), "shards")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document, from the shard files: ``doc_id``, ``start`` (ids
    of all documents before it), ``n_tokens``, ``ids_crc32``."""
    spark = manifest.sparkSession
    # One row per shard, each of millions of ids: their running total is one small window.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                files, path = open_fs(uri)
                with files.open_input_file(path) as source:
                    shard = Shard(source.read())
                ids, table = shard.ids(), json.loads(shard.documents)
                sizes = np.array([n for _, n in table], np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in table], pa.int64()), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(spread(spark), "file").mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
