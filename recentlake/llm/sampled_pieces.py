"""SentencePiece encoding and decoding (operator 7): sampled segmentations.

A text becomes symbols: a space before it, spaces as the piece mark, and each
character without a piece of its own as its UTF-8 bytes (byte pieces).  All
ways to cut the symbols into pieces form a lattice; a segmentation has the
probability of the product of its pieces' weights to the power ``alpha``,
normalised.  Forward filtering sums the weights of all ways to reach each
place, backward sampling draws the pieces from the end.  A BPE model stores
merge ranks and no probabilities; a piece of rank ``r`` gets the Zipf weight
``1 / (r + OFFSET)``.

No piece spans a place before a space or beside a byte symbol, so the lattice
is a chain of small ones (words).  Equal words share one lattice, and all
words of a block are filtered and sampled together in numpy.  A draw is a
hash of the row key, the word's number and the step: a row's segmentation
depends on nothing else, not on partitions or blocks.

Decoding joins the pieces' bytes, so ``decode(encode(text)) == text`` for
every text, white space and the piece mark itself included.

Special cases: null text encodes as null, the empty text as the piece of the
leading space, which decodes to the empty text; a null row key is a key of
its own and rows of equal key and text get equal pieces; very long words are
lattices like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import HashIndex, mix64

ALPHA = 1.0
OFFSET = 10.0
SEED = 29
MARK = 0x2581
#: Symbols above all characters stand for single bytes.
BYTE = 0x110000
#: Probabilities are counted in these units, so that sums are exact.
UNIT = 1 << 30
#: Characters encoded at once: a lattice of some 100 bytes for each.
BLOCK_CHARS = 1 << 19

_FACTOR = 0x2545F4914F6CDD1D
_CHUNK, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model as arrays, and sampling and decoding with them."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_id = np.zeros(256, np.int32)
        symbols, ids, weights = [], [], []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                symbols.append(np.array([ord(c) for c in piece], np.uint32))
                ids.append(i)
                weights.append(-alpha * np.log(OFFSET - model.get_score(i)))
        self.known = np.zeros(BYTE, bool)
        for s in symbols:
            if len(s) == 1:
                self.known[s[0]] = True
        self.longest = max(map(len, symbols))
        self._powers(1 << 16)
        # Every beginning of a piece, by its hash, with the piece that ends there.
        found: dict[int, int] = {}
        for k, s in enumerate(symbols):
            h = self._whole_hashes(s)
            for n, x in enumerate(h.tolist(), 1):
                if n == len(s):
                    found[x] = k
                else:
                    found.setdefault(x, -1)
        prefixes = np.array(sorted(found), np.uint64)
        self.prefixes = HashIndex(prefixes)
        piece = np.array([found[x] for x in prefixes.tolist()], np.int64)
        self.prefix_id = np.where(piece >= 0, np.array(ids)[piece], -1).astype(np.int32)
        self.prefix_weight = np.where(piece >= 0, np.array(weights)[piece], 0.0)
        flat = b"".join(self.bytes_of)
        self.flat = np.frombuffer(flat, np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.starts = np.cumsum(self.sizes) - self.sizes

    # -- hashes of symbol runs

    def _powers(self, n: int) -> None:
        if n > len(getattr(self, "forward", ())):
            for name, factor in (("forward", _FACTOR), ("inverse", pow(_FACTOR, -1, 1 << 64))):
                table = np.full(max(n, 1 << 16), np.uint64(factor))
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def _sums(self, symbols: np.ndarray) -> np.ndarray:
        self._powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(mix64(symbols.astype(np.uint64) + np.uint64(1)) * self.forward[:len(symbols)], out=out[1:])
        return out

    def _hash(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (sums[hi] - sums[lo]) * self.inverse[lo]

    def _whole_hashes(self, symbols: np.ndarray) -> np.ndarray:
        return self._sums(symbols)[1:]

    # -- encoding

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and each text's first, with their number last."""
        joined = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
        known = self.known[joined] & (joined != MARK)
        space = joined == 32
        odd = np.flatnonzero(~known & ~space)
        spans = np.ones(len(joined), np.int64)
        encoded = [chr(c).encode() for c in joined[odd].tolist()]
        spans[odd] = np.fromiter(map(len, encoded), np.int64, len(odd))
        out = np.repeat(np.where(space, np.uint32(MARK), joined), spans)
        at = np.concatenate([[0], np.cumsum(spans)])
        if len(odd):
            where = np.repeat(at[odd], spans[odd]) + np.arange(int(spans[odd].sum())) - np.repeat(np.cumsum(spans[odd]) - spans[odd], spans[odd])
            out[where] = np.frombuffer(b"".join(encoded), np.uint8).astype(np.uint32) + np.uint32(BYTE)
        return out, at[firsts]

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each text's; ``keys``: uint64."""
        symbols, firsts = self.symbols(texts)
        n = len(symbols)
        raw = symbols >= BYTE
        cut = np.ones(n, bool)
        cut[1:] = ((symbols[1:] == MARK) & (symbols[:-1] != MARK)) | raw[1:] | raw[:-1]
        cut[firsts[:-1]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        sums = self._sums(symbols)
        kind, first_of, of = np.unique(self._hash(sums, begin, end), return_index=True, return_inverse=True)
        del kind
        # Equal hashes must be equal words: compare every word with the first of its kind.
        spans = end - begin
        same = np.array_equal(spans, spans[first_of][of])
        if same:
            there = np.repeat(begin[first_of][of] - begin, spans) + np.arange(n)
            same = np.array_equal(symbols[there], symbols)
        if not same:
            first_of = of = np.arange(len(begin))
        words = _Lattice(self, symbols, sums, begin[first_of], end[first_of])
        text_of = np.searchsorted(firsts, begin, side="right") - 1
        number = np.arange(len(begin)) - np.searchsorted(begin, firsts[:-1])[text_of]
        draw = mix64(keys)[text_of] + number.astype(np.uint64) * _CHUNK
        ids, per_word = words.sample(of, draw)
        bounds = np.concatenate([[0], np.cumsum(per_word)])[np.searchsorted(begin, firsts)]
        return ids, bounds

    # -- decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat[np.repeat(self.starts[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        ends = total[bounds].tolist()
        return [data[a + 1:b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Lattice:
    """Lattices of many distinct words, forward filtered."""

    def __init__(self, pieces: Pieces, symbols, sums, begin, end):
        spans = end - begin
        self.first = np.cumsum(spans + 1) - (spans + 1)  # a word of k symbols has k + 1 nodes
        n_nodes = int((spans + 1).sum())
        word = np.repeat(np.arange(len(begin)), spans)
        place = np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
        at = begin[word] + place
        node = self.first[word] + place
        left = spans[word] - place
        lo, hi, ids, weights = [], [], [], []
        raw = symbols[at] >= BYTE
        lo.append(node[raw])
        hi.append(node[raw] + 1)
        ids.append(pieces.byte_id[symbols[at[raw]].astype(np.int64) - BYTE])
        weights.append(np.zeros(int(raw.sum())))
        alive = np.flatnonzero(~raw)
        for size in range(1, pieces.longest + 1):
            alive = alive[left[alive] >= size]
            if not len(alive):
                break
            start = at[alive]
            hit = pieces.prefixes.find(pieces._hash(sums, start, start + size))
            alive, hit = alive[hit >= 0], hit[hit >= 0]
            whole = pieces.prefix_id[hit] >= 0
            lo.append(node[alive[whole]])
            hi.append(lo[-1] + size)
            ids.append(pieces.prefix_id[hit[whole]])
            weights.append(pieces.prefix_weight[hit[whole]])
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        ids, weights = np.concatenate(ids), np.concatenate(weights)
        # Forward: the nodes at one distance from their word's start at a time.
        depth = (np.arange(n_nodes) - np.repeat(self.first, spans + 1))[hi]
        order = np.argsort((depth << 38) | (hi << 8) | (hi - lo))
        lo, hi, ids, weights, depth = lo[order], hi[order], ids[order], weights[order], depth[order]
        bounds = np.searchsorted(depth, np.arange(1, int(spans.max(initial=0)) + 2))
        total = np.zeros(n_nodes)
        share = np.empty(len(hi))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            value, target = total[lo[a:b]] + weights[a:b], hi[a:b]
            group = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            most = np.maximum.reduceat(value, group)
            counts = np.diff(np.append(group, b - a))
            value = np.exp(value - np.repeat(most, counts))
            sums_ = np.add.reduceat(value, group)
            total[target[group]] = most + np.log(sums_)
            share[a:b] = value / np.repeat(sums_, counts)
        # Shares of the edges into each node as counts, the largest first, so
        # that a draw is exact and mostly ends at the first edge.
        units = np.maximum(np.round(share * UNIT).astype(np.int64), 1)
        order = np.argsort((hi << 31) | (UNIT - units), kind="stable")
        self.lo, self.ids = lo[order], ids[order]
        self.upto = np.cumsum(units[order])
        counts = np.bincount(hi, minlength=n_nodes)
        self.edge = np.cumsum(counts) - counts
        padded = np.concatenate([[0], self.upto])
        self.base = padded[self.edge]
        self.width = padded[self.edge + counts] - self.base
        self.last = self.first + spans

    def sample(self, words: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each of ``words`` in order, and their number for each."""
        node = self.last[words]
        goal = self.first[words]
        active = np.arange(len(words))
        steps, counts = [], np.zeros(len(words), np.int64)
        k = 0
        while len(active):
            turn = np.array([k + 1], np.uint64) * _STEP
            u = (mix64(draw[active] ^ turn) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            here = node[active]
            target = self.base[here] + np.minimum((u * self.width[here]).astype(np.int64), self.width[here] - 1)
            edge = self.edge[here]
            beyond = np.flatnonzero(self.upto[edge] <= target)
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[self.upto[edge[beyond]] <= target[beyond]]
            steps.append((active, self.ids[edge]))
            counts[active] += 1
            node[active] = self.lo[edge]
            active = active[self.lo[edge] != goal[active]]
            k += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, ids) in enumerate(steps):  # drawn from the end
            out[ends[who] - 1 - k] = ids
        return out, counts


_PIECES: dict[tuple[str, float], Pieces] = {}


def pieces(path: str, alpha: float) -> Pieces:
    """The worker's pieces, kept between tasks."""
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


def row_keys(column: pa.Array, seed: int = SEED) -> np.ndarray:
    """64-bit keys of integer row keys; null has its own."""
    values = np.asarray(column.cast(pa.int64()).fill_null(0)).astype(np.int64).view(np.uint64)
    keys = mix64(values + np.array([seed], np.uint64) * _CHUNK)
    keys[np.asarray(column.is_null())] = mix64(np.array([seed], np.uint64))[0]
    return keys


# -- on Spark ----------------------------------------------------------------------


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", model: str | None = None,
            alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids``, its sampled pieces."""
    path = model or default_model()
    kept = [c for c in docs.columns if c not in (text, ids)]
    picked = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{ids}` array<int>"])

    def run(batches):
        own = pieces(path, alpha)
        for batch in batches:
            texts = batch.column(len(kept) + 1).to_pylist()
            keys = row_keys(batch.column(len(kept)), seed)
            lists, lo = [], 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < BLOCK_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                flat, bounds = own.encode([t or "" for t in texts[lo:hi]], keys[lo:hi])
                lists.append((flat, bounds))
                lo = hi
            offsets = np.concatenate([[0], *(b[1:] + sum(len(f) for f, _ in lists[:k]) for k, (_, b) in enumerate(lists))])
            flat = np.concatenate([np.zeros(0, np.int32), *(f for f, _ in lists)])
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            column = pa.ListArray.from_arrays(column.offsets, column.values, mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), column], [*kept, ids])

    return picked.mapInArrow(run, schema)


def decoded(frame: DataFrame, ids: str = "ids", text: str = "text", model: str | None = None) -> DataFrame:
    """``frame`` with ``ids`` replaced by ``text`` and the ids' number and
    crc32 (of little-endian 32-bit ids) in ``n_pieces`` and ``ids_crc32``."""
    path = model or default_model()
    new = (text, "n_pieces", "ids_crc32")
    kept = [c for c in frame.columns if c not in (ids, *new)]
    kinds = dict(frame.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{text}` string, n_pieces bigint, ids_crc32 bigint"])

    def run(batches):
        own = pieces(path, ALPHA)
        for batch in batches:
            column = batch.column(len(kept))
            absent = column.is_null().to_pylist()
            column = column.fill_null(pa.scalar([], column.type))
            bounds = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values).astype(np.int32)[:bounds[-1]]
            texts = own.decode(flat, bounds)
            data = memoryview(flat.astype("<i4").tobytes())
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            none = pa.array(absent, pa.bool_())
            made = [pa.array(texts, pa.string()), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
            made = [pa.compute.if_else(none, pa.scalar(None, m.type), m) for m in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *made], [*kept, *new])

    import pyarrow.compute  # noqa: F401

    return frame.select(*(F.col(f"`{c}`") for c in kept), ids).mapInArrow(run, schema)
