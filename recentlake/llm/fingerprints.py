"""Document fingerprints (operator 2): improbable-feature digests.

Features are byte windows of ``WINDOW`` bytes at every place of the UTF-8
text.  A window's Shannon entropy, in steps of ``1 / STEPS`` bit, is ranked by
how rare that entropy is among all windows of the whole corpus: the rarer, the
lower the rank.  Of each run of ``RUN`` consecutive windows the one of lowest
rank (then lowest hash) is a candidate, and a window that is the candidate of
``POPULARITY`` runs or more is selected.  Texts under ``SHORT_TEXT`` bytes, which
have few or no such windows, get features of the narrower ``SHORT`` windows as
well, chosen by the same rule.  Selected features go into a chain of Bloom filters of ``FILTER_BITS`` bits, ``FILTER_FEATURES`` to a filter; the
chain in base64 is the fingerprint.  Two chains are compared by the share of
common bits beyond chance, filter by filter.

Entropies of all windows are sliding sums: the counts of the leaving and the
entering byte within the window come from ``WINDOW - 1`` shifted comparisons
of the whole byte array, so the cost for each byte is constant.

:func:`with_next` pairs each row with the next one by ``doc_id`` with one
shuffle of the texts and no global window.

Special cases: a text of which no window is selected is one feature, its whole
hash; null and empty texts have the empty fingerprint, which equals itself (likeness
1) and nothing else (0); null ``doc_id`` rows come last, equal ``doc_id`` rows
in text order; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import _BYTE_VALUES, mix64, spread, text_blocks

WINDOW = 64
RUN = 64
POPULARITY = 16
#: Window, run and popularity of the further features of texts under SHORT_TEXT bytes.
SHORT = (12, 12, 3)
SHORT_TEXT = 512
STEPS = 16
BINS = 6 * STEPS + 1
#: Windows of less entropy than this (in bits) tell nothing: never selected.
LEAST_ENTROPY = 1.0
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
BLOCK = 256 << 10

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = 0x2545F4914F6CDD1D


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        table = np.full(n, np.uint64(factor))
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def entropy_bins(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Entropy step of the window that starts at each place."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint8)
    after = np.zeros(len(data), np.uint8)
    before = np.zeros(len(data), np.uint8)
    for d in range(1, window):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    c = np.arange(window + 1, dtype=np.float64)
    # Sums of c * log2(c) over the bytes of a window, in fixed point.
    weight = np.round(c * np.log2(np.maximum(c, 1)) * 65536).astype(np.int64)
    gain = weight[1:] - weight[:-1]
    total = np.empty(n, np.int64)
    total[0] = weight[np.bincount(data[:window], minlength=256)].sum()
    total[1:] = gain[before[window:]] - gain[after[:n - 1]]
    np.cumsum(total, out=total)
    entropy = np.log2(window) - total / (65536.0 * window)
    return np.clip(np.floor(entropy * STEPS + 1e-6), 0, BINS - 1).astype(np.uint8)


def _valid(n: int, offs: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose window lies within one text."""
    marks = np.zeros(n + 1, np.int32)
    sizes = np.diff(offs)
    whole = sizes >= window
    np.add.at(marks, offs[:-1][whole], 1)
    np.add.at(marks, offs[1:][whole] - window + 1, -1)
    return np.cumsum(marks)[:n] > 0


def short_texts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, bytes and offsets of the texts under SHORT_TEXT bytes."""
    sizes = np.diff(offs)
    short = (sizes > 0) & (sizes < SHORT_TEXT)
    return np.flatnonzero(short), data[np.repeat(short, sizes)], np.concatenate([[0], np.cumsum(sizes[short])])


def count_bins(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Windows of each entropy step, those of short texts included."""
    total = np.zeros(BINS, np.int64)
    for raw, at, window in ((data, offs, WINDOW), (*short_texts(data, offs)[1:], SHORT[0])):
        bins = entropy_bins(raw, window)
        total += np.bincount(bins[_valid(len(raw), at, window)[:len(bins)]], minlength=BINS)
    return total


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step: 0 for the rarest."""
    out = np.empty(BINS, np.uint64)
    out[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS, dtype=np.uint64)
    return out


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any stretch follows, and the
    factors that free it of its place."""
    forward, inverse = _powers(max(1 << 18, len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * forward[:len(data)], out=sums[1:])
    return sums, inverse


def selected(data: np.ndarray, offs: np.ndarray, rank: np.ndarray, window: int, run: int,
             popularity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of the selected windows; ``run`` is at most
    ``window``, so that no run of windows reaches into a second text."""
    bins = entropy_bins(data, window)
    m = len(bins)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums, inverse = _sums(data)
    hashes = mix64((sums[window:] - sums[:m]) * inverse[:m])
    keys = np.full(m + 2 * run, _NONE)
    body = keys[run:run + m]
    body[:] = (rank[bins] << np.uint64(57)) | (hashes >> np.uint64(7))
    body[~(_valid(len(data), offs, window)[:m] & (bins >= LEAST_ENTROPY * STEPS))] = _NONE
    low, reach = keys, 1
    while reach < run:  # smallest key of the next ``run`` places, by doubling
        step = min(reach, run - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    long = np.flatnonzero(np.diff(offs) >= window)
    lasts = offs[1:][long] - window  # last valid place of each text
    # A stretch of equal keys ends with its text, though the next may begin alike.
    changes = low[1:] != low[:-1]
    changes[(lasts + run)[lasts + run < len(changes)]] = True
    edge = np.flatnonzero(changes) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(low)]])
    picked = (ends - starts >= popularity) & (low[starts] != _NONE)
    # The last run of a selected window lies before or at it, in its own text's reach.
    return long[np.searchsorted(lasts, ends[picked] - 1 - run)], low[starts[picked]]


def features(data: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected features of each text: ``(row, feature)``, rows ascending."""
    bare = np.diff(offs) > 0  # texts without a selected window
    row, feature = selected(data, offs, rank, WINDOW, RUN, POPULARITY)
    short, raw, at = short_texts(data, offs)
    short_row, narrow = selected(raw, at, rank, *SHORT)
    rows, found = [row, short[short_row]], [feature, narrow]
    for r in rows:
        bare[r] = False
    whole = np.flatnonzero(bare)
    if len(whole):
        sums, inverse = _sums(data)
        rows.append(whole)
        found.append(mix64((sums[offs[1:]] - sums[offs[:-1]])[whole] * inverse[offs[:-1][whole]]))
    row, feature = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(row, kind="stable")
    return row[order], feature[order]


def chains(data: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Each text's Bloom filters, packed: an array (filters, bytes)."""
    row, feature = features(data, offs, rank)
    n = len(offs) - 1
    counts = np.bincount(row, minlength=n)
    filters = -(-counts // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(filters)])
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    bits = np.zeros((int(first[-1]), FILTER_BITS), bool)
    mixed = mix64(feature)
    where = first[row] + ordinal // FILTER_FEATURES
    for k in range(HASHES):
        bits[where, (mixed >> np.uint64(11 * k)).astype(np.int64) & (FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best share of common
    bits beyond chance, averaged by the bits set."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    set_a, set_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for k in range(len(a)):
        common = np.bitwise_count(a[k] & b).sum(1, dtype=np.int64)
        most = np.minimum(set_a[k], set_b)
        chance = set_a[k] * set_b / FILTER_BITS
        score = (common - chance) / np.maximum(most - chance, 1e-9)
        total += set_a[k] * float(np.clip(score, 0, 1).max())
    return total / float(set_a.sum())


def fingerprint(text: str | None, rank: np.ndarray) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return chains(raw, np.array([0, len(raw)]), rank)[0]


# -- on Spark ----------------------------------------------------------------------


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy steps over all windows of all texts."""

    def count(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, _, data, offs in text_blocks(batch.column("text"), BLOCK):
                total += count_bins(data, offs)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], ["bin", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bin bigint, n bigint") \
        .groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows
    counts = np.zeros(BINS, np.int64)
    for r in rows:
        counts[r["bin"]] = r["n"]
    return ranks(counts)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in runs by ascending ``doc_id`` (column ``bucket``),
    each run followed by the first row of the next (``is_next``).

    Runs are cut at quantiles of the ids, as many as there are partitions, and
    each is a partition of its own; only these cuts, and the first id of each run, are on the driver.
    """
    spark = docs.sparkSession
    n = spread(spark)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) or [], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(doc_id):
        import pandas as pd

        known = doc_id.notna()
        out = np.full(len(doc_id), len(cuts) + 1, np.int32)
        out[known] = np.searchsorted(cuts, doc_id[known].astype("int64"), side="right")
        return pd.Series(out)

    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = picked.withColumn("bucket", bucket_of("doc_id"))
    firsts = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    followers = [(b, firsts[(k + 1) % len(firsts)][1]) for k, (b, _) in enumerate(firsts)]
    heads = spark.createDataFrame(followers, "bucket int, __first bigint")  # a row for each run
    after = picked.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("__first"))) \
        .select("doc_id", "text", "bucket", F.lit(True).alias("is_next"))
    return placed.withColumn("is_next", F.lit(False)).unionByName(after).repartitionById(n + 1, "bucket") \
        .sortWithinPartitions("bucket", "is_next", F.col("doc_id").asc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    rank = rarity(docs)
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def block_chains(texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        return chains(np.frombuffer(b"".join(raw), np.uint8), offs, rank)

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (doc_id, text) of a run, the last only as the next one."""
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        plain, other = block_chains(texts), block_chains(changed)
        columns = [
            [d for d, _ in rows[:-1]], [len(t) for t in texts[:-1]],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            [encode(c) for c in plain[:-1]], [encode(c) for c in other],
            [likeness(a, b) for a, b in zip(plain, other)],
            [likeness(a, b) for a, b in zip(plain, plain[1:])],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        held, size, bucket, closed = [], 0, None, False
        for batch in batches:
            for doc_id, text, b, is_next in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "is_next")), strict=True):
                if b != bucket:
                    held, size, bucket, closed = [], 0, b, False
                if closed:
                    continue  # further rows with the next run's first id
                held.append((doc_id, text))
                size += len(text)
                closed = is_next
                if len(held) > 1 and (closed or size >= BLOCK):
                    yield digest(held)
                    held, size = held[-1:], len(text)

    return with_next(docs).mapInArrow(run, schema)
