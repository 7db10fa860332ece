"""BPE encoding and decoding (operator 12) by merge ranks.

A word part starts as a doubly linked list of symbols, one a byte.  A priority
queue holds the mergeable neighbours as (rank, place): the lowest rank, then
the leftmost, is merged into its left symbol, which brings up to two new
neighbours into the queue.  Entries whose symbols have changed meanwhile are
stale and skipped when they come up.  A part of n bytes takes O(n log n)
whatever its length.  Ids are decoded by joining their vocabulary strings.

``MergeTable`` reads a ``tokenizer.json`` with a byte-level BPE model and an
end-of-word suffix.  Results equal those of the tokenizers library (without
truncation, padding and added special tokens): the strings of added tokens are
found in the raw text first, the rest is normalised, cut into parts and
encoded.  Words of the characters ``_PLAIN`` are normalised and cut here by
the tokenizer's own rules; the rest is normalised and cut by the library's
normaliser and pre-tokenizer, as its Unicode tables decide there.  Every part
is merged here.

The tokenizer drops white space and no token spans it, so a text's ids are
those of its words in order.  A worker remembers the ids of ``MEMO_WORDS``
words at most and then starts anew.  One row is one text, nothing is shuffled.

Special cases: null, empty and blank texts have no ids and decode to the empty
text; rows are independent, so null and repeated ids of documents do not
matter; ids out of the vocabulary are left out by the decoder, as by the
library; null ids decode to null.  Columns named like the results are
replaced, all others are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import text_blocks

MEMO_WORDS = 600_000

#: Rules of the tokenizer's own cut into parts, fixed values.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Printable Latin characters: composed already, and lower-cased one by one
#: alike by the library and by Python (U+0130 is not).
_PLAIN = re.compile(r"[\x21-\x7E\xA1-\xAC\xAE-įı-ɏ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary strings: itself
    where it is printable, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class MergeTable:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = [vocab.get(c, -1) for c in chars]
        self.final = [vocab.get(c + suffix, -1) for c in chars]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        by_length = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        strings = {i: s for s, i in (vocab | self.added).items()}
        self.strings = [strings.get(i, "").encode("utf-8") for i in range(max(strings, default=-1) + 1)]
        self.known = np.array([i in strings for i in range(len(self.strings))], bool)
        library = Tokenizer.from_file(path)
        self._normalised, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.parts: dict[bytes, bytes] = {}
        self.words = _Words(self)

    def merged(self, part: bytes) -> list[int]:
        """The ids of one word part."""
        symbols = [self.inner[b] for b in part[:-1]]
        symbols.append(self.final[part[-1]])
        symbols = [s for s in symbols if s >= 0]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for at in range(n - 1):
            found = merges.get((symbols[at], symbols[at + 1]))
            if found:
                queue.append((found[0], at, symbols[at], symbols[at + 1]))
        heapq.heapify(queue)
        while queue:
            _, at, a, b = heapq.heappop(queue)
            nxt = after[at]
            if symbols[at] != a or nxt >= n or symbols[nxt] != b:
                continue  # stale: one of the two was merged meanwhile
            symbols[at] = merges[a, b][1]
            symbols[nxt] = -1
            nxt = after[at] = after[nxt]
            if nxt < n:
                before[nxt] = at
                found = merges.get((symbols[at], symbols[nxt]))
                if found:
                    heapq.heappush(queue, (found[0], at, symbols[at], symbols[nxt]))
            prev = before[at]
            if prev >= 0:
                found = merges.get((symbols[prev], symbols[at]))
                if found:
                    heapq.heappush(queue, (found[0], prev, symbols[prev], symbols[at]))
        return [s for s in symbols if s >= 0]

    def _part(self, part: bytes) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= MEMO_WORDS:
                self.parts.clear()
            ids = self.parts[part] = _packed(self.merged(part))
        return ids

    def word(self, word: bytes) -> bytes:
        """The ids of a word (no white space of ASCII in it), as bytes."""
        text = word.decode("utf-8")
        out = []
        for piece in self.added_pattern.split(text) if self.added_pattern else [text]:
            if piece in self.added:
                out.append(_packed([self.added[piece]]))
            elif _PLAIN.fullmatch(piece):
                out += [self._part(p.encode("utf-8")) for p in _PARTS.findall(piece.lower())]
            elif piece:
                out += [self._part(bytes(map(self.byte_of.__getitem__, p))) for p, _ in self._cut(self._normalised(piece))]
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit integers."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The vocabulary strings of ``ids``, joined by a space: the file has
        no decoder of its own."""
        fits = (ids >= 0) & (ids < len(self.strings))
        if not fits.all() or not self.known[ids].all():
            ids = ids[fits]
            ids = ids[self.known[ids]]
        return b" ".join(map(self.strings.__getitem__, ids.tolist()))


class _Words(dict):
    """Words and their ids, learnt as they come up."""

    def __init__(self, table: MergeTable):
        self.table = table

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = self.table.word(word)
        return ids


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    """The worker's table, kept between tasks."""
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


# -- DataFrames ----------------------------------------------------------------


def _with_results(df: DataFrame, column: str, results: dict[str, str], per_batch) -> DataFrame:
    """``df`` with ``results`` (name -> type) that ``per_batch`` makes of ``column``."""
    kept = [f for f in df.schema.fields if f.name.lower() not in results]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("__source"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{k} {t}" for k, t in results.items())])
    names = [*(f.name for f in kept), *results]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *per_batch(batch.column(batch.num_columns - 1))], names=names)

    return source.mapInArrow(made, schema)


def encoded(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the ``ids`` of ``text``, their number ``n_tokens`` and
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers)."""
    path = tokenizer or default_tokenizer()

    def encode(texts: pa.Array) -> list[pa.Array]:
        table = merge_table(path)
        parts, sizes, digests = [], [], []
        for lo, hi, data, offs in text_blocks(texts):
            content = data.tobytes()
            for r in range(hi - lo):
                ids = table.encode(content[offs[r]:offs[r + 1]])
                parts.append(ids)
                sizes.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        flat = np.frombuffer(b"".join(parts), "<i4")
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())]

    return _with_results(docs, text, {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string"}, encode)


def decoded(docs: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded_text``, the text that ``ids`` stand for."""
    path = tokenizer or default_tokenizer()

    def decode(lists: pa.Array) -> list[pa.Array]:
        table = merge_table(path)
        offsets = np.asarray(lists.offsets)
        flat = np.asarray(lists.values.fill_null(-1))
        out = [table.decode(flat[offsets[r]:offsets[r + 1]]) if ok else None for r, ok in enumerate(lists.is_valid().to_pylist())]
        return [pa.array(out, pa.binary()).cast(pa.string())]

    return _with_results(docs, ids, {"decoded_text": "string"}, decode)
