"""Quality classifier (operator 8): a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and passed through ``FILTERS`` learned
filters over ``WIDTH`` bytes at every place.  Places are cut into chunks of
``CHUNK`` bytes, each overlapping the next by half, that cover the whole text;
every filter is max-pooled within each chunk.  The largest and the mean pooled
activation over all chunks of a document are combined into one logit and one
probability.  Overlapping chunks share their filter responses: these are
computed once per byte, pooled over half chunks, and two halves make a chunk.

Training: gradient descent on whole texts of at most ``TRAIN_PER_CLASS``
labelled documents of either class, the first in a fixed pseudo-random order.
The sample is bounded by that parameter, is gathered into one task, and only
the fitted weights (some kB) reach the driver.  Scoring covers all documents.

Special cases: null and empty texts are one chunk of padding and get the score
of that; labels that are null, and texts without a label, are not trained on;
repeated label rows count as often as they occur; without both classes among the training rows every
score is the same 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recentlake.llm.common import text_blocks

WIDTH, FILTERS, EMBED = 5, 12, 6
CHUNK = 1024
HALF = CHUNK // 2
TRAIN_PER_CLASS = 600
EPOCHS = 10
BATCH = 24
RATE = 0.02
SEED = 17
THRESHOLD = 0.3
FOLDS = 5

SHAPES = {"embed": (256, EMBED), "filters": (WIDTH, EMBED, FILTERS), "bias": (FILTERS,),
          "top": (FILTERS,), "mean": (FILTERS,), "base": (1,)}


def chunks_of(text: bytes) -> np.ndarray:
    """The overlapping chunks of a text, each with the bytes its last filter
    places reach into; texts end in zero padding."""
    n = max(1, -(-len(text) // HALF) - 1)
    padded = np.zeros((n + 1) * HALF + WIDTH - 1, np.uint8)
    padded[:len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::HALF][:n]


def tables(net: dict) -> np.ndarray:
    """Response of each filter to each byte at each of its places."""
    return np.einsum("be,wef->wbf", net["embed"], net["filters"]).astype(np.float32)


def _places(n_bytes: int) -> int:
    return max(1, n_bytes)


# -- training ---------------------------------------------------------------------


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> dict | None:
    """Weights fitted to ``labels``, or None without both classes."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(SEED)
    net = {"embed": rng.normal(0, 0.5, SHAPES["embed"]), "filters": rng.normal(0, 0.4, SHAPES["filters"]),
           "bias": np.zeros(FILTERS), "top": rng.normal(0, 0.3, FILTERS), "mean": rng.normal(0, 0.3, FILTERS), "base": np.zeros(1)}
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            grads = {k: np.zeros_like(v) for k, v in net.items()}
            response = tables(net)
            by_byte = np.zeros(response.shape)
            batch = order[lo:lo + BATCH]
            for k in batch:
                _backward(net, response, texts[k], y[k], grads, by_byte, len(batch))
            grads["embed"] = np.einsum("wbf,wef->be", by_byte, net["filters"])
            grads["filters"] = np.einsum("wbf,be->wef", by_byte, net["embed"])
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return net


def _pool(response: np.ndarray, chunk: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The strongest of the first ``places`` places for each filter; those
    after them are padding."""
    sums = response[0][chunk[:places]]
    for w in range(1, WIDTH):
        sums += response[w][chunk[w:w + places]]
    at = sums.argmax(0)
    return at, sums[at, np.arange(FILTERS)]


def forward(net: dict, response: np.ndarray, text: bytes):
    """Chunks, pooled places, activations and the score of one text."""
    chunks, n = chunks_of(text), _places(len(text))
    pooled = [_pool(response, c, min(CHUNK, n - k * HALF)) for k, c in enumerate(chunks)]
    raw = np.array([p for _, p in pooled], np.float64) + net["bias"]
    act = np.maximum(raw, 0)
    logit = act.max(0) @ net["top"] + act.mean(0) @ net["mean"] + net["base"][0]
    return chunks, pooled, raw, act, 1 / (1 + np.exp(-logit))


def _backward(net, response, text, label, grads, by_byte, of) -> None:
    """Adds a document's part of the gradient; it flows through each chunk's
    strongest place of each filter only."""
    chunks, pooled, raw, act, score = forward(net, response, text)
    best, n = act.argmax(0), len(chunks)
    top, mean = act[best, np.arange(FILTERS)], act.mean(0)
    slope = (score - label) / of
    grads["top"] += slope * top
    grads["mean"] += slope * mean
    grads["base"] += slope
    back = np.repeat(slope * net["mean"][None] / n, n, 0)
    back[best, np.arange(FILTERS)] += slope * net["top"]
    back[raw <= 0] = 0
    grads["bias"] += back.sum(0)
    columns = np.arange(FILTERS)
    for (at, _), chunk, g in zip(pooled, chunks, back, strict=True):
        for w in range(WIDTH):
            np.add.at(by_byte[w], (chunk[at + w], columns), g)


# -- scoring ----------------------------------------------------------------------


class Scorer:
    """Scores of many texts at once, with the filters of adjacent bytes joined
    into tables of byte pairs."""

    def __init__(self, net: dict):
        t = tables(net)
        self.pairs = [(t[w][:, None] + t[w + 1][None]).reshape(65536, FILTERS) for w in range(0, WIDTH - 1, 2)]
        self.last = t[WIDTH - 1] if WIDTH % 2 else None
        self.net = net

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        sizes = np.diff(offs)
        places = np.maximum(sizes, 1)
        firsts = np.concatenate([[0], np.cumsum(places + WIDTH - 1)])
        padded = np.zeros(firsts[-1] + WIDTH, np.uint8)
        shift = np.repeat(firsts[:-1] - offs[:-1], sizes)
        padded[np.arange(len(data)) + shift] = data
        pair = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
        pair = (pair >> np.uint16(8)) | (pair << np.uint16(8))  # first byte high
        n = int(firsts[-1])
        sums = np.take(self.pairs[0], pair[:n], axis=0)
        for k, table in enumerate(self.pairs[1:], 1):
            sums += np.take(table, pair[2 * k:2 * k + n], axis=0)
        if self.last is not None:
            sums += np.take(self.last, padded[WIDTH - 1:WIDTH - 1 + n], axis=0)
        # Half chunks of every document; the places of padding between documents are left out.
        halves = -(-places // HALF)
        half_first = np.concatenate([[0], np.cumsum(halves)])
        starts = np.repeat(firsts[:-1], halves) + HALF * (np.arange(half_first[-1]) - np.repeat(half_first[:-1], halves))
        ends = np.minimum(starts + HALF, np.repeat(firsts[:-1] + places, halves))
        pooled = np.maximum.reduceat(sums, np.column_stack([starts, ends]).ravel(), axis=0)[::2]
        # A chunk is two halves; a text of one half is one chunk.
        joined = pooled.copy()
        joined[:-1] = np.maximum(pooled[:-1], pooled[1:])
        is_chunk = np.ones(len(pooled), bool)
        is_chunk[half_first[1:] - 1] = halves == 1
        alone = half_first[:-1][halves == 1]
        joined[alone] = pooled[alone]
        act = np.maximum(joined[is_chunk] + self.net["bias"], 0)
        n_chunks = np.maximum(halves - 1, 1)
        bounds = np.concatenate([[0], np.cumsum(n_chunks)])[:-1]
        top = np.maximum.reduceat(act, bounds, axis=0)
        mean = np.add.reduceat(act, bounds, axis=0) / n_chunks[:, None]
        return 1 / (1 + np.exp(-(top @ self.net["top"] + mean @ self.net["mean"] + self.net["base"][0])))


# -- on Spark ---------------------------------------------------------------------


def held_out_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> dict | None:
    """The network fitted to a bounded sample of the labelled rows outside the
    held-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.coalesce(~held_out_column(), F.lit(False))).select("doc_id", F.col(label).alias("__y"))
    sample = None
    for value in (0, 1):
        some = known.where(F.col("__y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = some if sample is None else sample.unionByName(some)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .join(F.broadcast(sample), "doc_id")  # at most 2 * per_class rows
    ordered = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).coalesce(1)

    def learn(batches):
        words, marks = [], []
        for batch in batches:
            words += batch.column("text").cast(pa.binary()).to_pylist()
            marks += batch.column("__y").to_pylist()
        net = train(words, marks)
        if net:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(net)), pa.array([v.ravel().tolist() for v in net.values()], pa.list_(pa.float64()))], ["name", "values"])

    rows = ordered.mapInArrow(learn, "name string, values array<double>").collect()  # the weights
    return {r["name"]: np.array(r["values"]).reshape(SHAPES[r["name"]]) for r in rows} or None


def scored(docs: DataFrame, net: dict | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    picked = docs.select("doc_id", F.coalesce(held_out_column(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        scorer = Scorer(net) if net else None
        for batch in batches:
            parts = [scorer.score(data, offs) if scorer else np.full(hi - lo, 0.5)
                     for lo, hi, data, offs in text_blocks(batch.column("text"), 512 << 10)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
