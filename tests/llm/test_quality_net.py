import zlib

import numpy as np
import pyarrow as pa
from helpers import documents, odd_rows, prose

from recentlake.llm import quality_net as q
from recentlake.llm.common import text_blocks


def corpus(n=260):
    rows, marks = [], []
    for k in range(n):
        good = k % 3 > 0
        text = prose(40 + k % 90, k, 3000)
        rows.append((k, text if good else text.upper().replace(" ", "!! ")))
        marks.append((k, int(good), 0))
    return rows, marks


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(q, "EPOCHS", 6)
    rows, marks = corpus()
    labels = spark.createDataFrame([*marks, (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in q.scored(docs, q.fit(docs, labels)).collect()}
    assert len(got) == len(rows)
    held = [k for k, r in got.items() if r["held_out"]]
    assert held and all((zlib.crc32(str(k).encode()) % 5 == 0) == got[k]["held_out"] for k in got)
    right = [got[k]["predicted"] == marks[k][1] for k in held]
    assert np.mean(right) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_fast_scores_equal_the_network_by_chunks():
    net = q.train([t.encode() for _, t in corpus(60)[0]], [k % 3 > 0 for k in range(60)], epochs=1)
    texts = ["", "a", prose(2000, 1), "é" * 300, "x" * 511, "x" * 512, "x" * 513, "x" * 1024, "x" * 1025, "x" * 1537, prose(100, 3)]
    response = q.tables(net)
    want = []
    for t in texts:
        raw = t.encode()
        whole = np.frombuffer(raw, np.uint8)
        chunks = q.chunks_of(raw)
        # Every place of the text is in a chunk, and each chunk's places beyond it are padding only.
        n = max(1, len(raw))
        pooled = []
        for k, c in enumerate(chunks):
            sums = sum(response[w][c[w:w + q.CHUNK]] for w in range(q.WIDTH))[:max(0, n - k * q.HALF)]
            pooled.append(sums.max(0))
        act = np.maximum(np.array(pooled) + net["bias"], 0)
        want.append(1 / (1 + np.exp(-(act.max(0) @ net["top"] + act.mean(0) @ net["mean"] + net["base"][0]))))
        assert whole.size == 0 or len(chunks) * q.HALF + q.HALF >= len(raw)
    got = np.concatenate([q.Scorer(net).score(d, o) for _, _, d, o in text_blocks(pa.array(texts), 3000)])
    assert np.allclose(got, want, atol=1e-5)


def test_training_scores_what_is_scored():
    """The forward pass of the training is the scorer, for short texts too."""
    rng = np.random.default_rng(4)
    net = {k: rng.normal(0, 0.6, shape) for k, shape in q.SHAPES.items()}
    texts = ["", "a", "ab", "x" * 300, prose(30, 1), "y" * 511, "y" * 513, "z" * 1023, "z" * 1025, prose(700, 2), "é" * 900]
    want = [q.forward(net, q.tables(net), t.encode())[-1] for t in texts]
    got = np.concatenate([q.Scorer(net).score(d, o) for _, _, d, o in text_blocks(pa.array(texts), 3000)])
    assert np.allclose(got, want, atol=1e-5)


def test_gradient_is_that_of_the_score():
    rng = np.random.default_rng(5)
    net = {k: rng.normal(0, 0.4, shape) for k, shape in q.SHAPES.items()}
    for text in (b"ab", prose(200, 3).encode()):
        loss = lambda n: -np.log(q.forward(n, q.tables(n).astype(np.float64), text)[-1])
        grads = {k: np.zeros_like(v) for k, v in net.items()}
        by_byte = np.zeros(q.tables(net).shape)
        q._backward(net, q.tables(net).astype(np.float64), text, 1, grads, by_byte, 1)
        for name in ("top", "mean", "bias", "base"):
            step = np.zeros_like(net[name])
            step[0] = 1e-6
            moved = loss({**net, name: net[name] + step}) - loss({**net, name: net[name] - step})
            assert abs(moved / 2e-6 - grads[name][0]) < 1e-4 * (1 + abs(grads[name][0]))


def test_odd_rows_no_labels_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(docs, none) is None
    assert {r["score"] for r in q.scored(docs, None).collect()} == {0.5}
    net = q.train([b"good text", b"BAD!!"], [1, 0], epochs=1)
    out = q.scored(docs, net).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert q.scored(docs.limit(0), net).count() == 0
